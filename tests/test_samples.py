"""Quantiles, draws and samples, against brute force."""

import bisect
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtally.operators import quantile_sketches
from gridtally.operators.draws import SampleTooLarge, draw
from gridtally.operators.quantiles import exact_quantiles
from gridtally.plans import samples

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def values(spark, numbers, parts=5):
    rows = [(None if n is None else float(n),) for n in numbers]
    return spark.createDataFrame(rows, "x double").repartition(parts)


def brute(numbers, p):
    ordered = sorted(numbers)
    h = (len(ordered) - 1) * p
    low, high, share = math.floor(h), math.ceil(h), h - math.floor(h)
    if share == 0:
        return ordered[low]
    return (1 - share) * ordered[low] + share * ordered[high]


def number_sets():
    rng = random.Random(5)
    return {
        "spread": [rng.gauss(0, 1) for _ in range(4000)],
        "one": [3.5],
        "two": [1.0, 2.0],
        "constant": [7.0] * 500,
        "hot": [0.0] * 2000 + [rng.random() for _ in range(1000)] + [-1.0] * 900,
        "two heavy": [0.0] * 1501 + [1.0] * 1501,
        "few between": [0.0] * 1500 + [0.25, 0.5, 0.75] + [1.0] * 1500,
        "outliers": [10.0**k for k in range(-300, 300)] + [rng.random() for _ in range(2000)],
        "infinite": [-math.inf, -math.inf, 1.0, 2.0, 3.0, math.inf],
    }


@pytest.mark.parametrize("name", list(number_sets()))
@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_quantiles_equal_brute_force(spark, name, accuracy):
    numbers = number_sets()[name]
    probs = [0.0, 0.5, 1.0] if name == "infinite" else PROBS
    got = exact_quantiles(values(spark, numbers + [None]), "x", probs, accuracy)
    assert got == [brute(numbers, p) for p in probs]
    if name not in ("infinite", "outliers"):
        assert np.allclose(got, np.quantile(numbers, probs))


def test_quantiles_of_nothing(spark):
    assert exact_quantiles(values(spark, [None]), "x", [0.5]) == [None]


def test_quantiles_take_nan_for_missing(spark):
    numbers = [float(i) for i in range(50)]
    got = exact_quantiles(values(spark, numbers + [float("nan")] * 40), "x", PROBS)
    assert got == [brute(numbers, p) for p in PROBS]


# -- draws -------------------------------------------------------------------------


def stratified(spark, rows):
    return spark.createDataFrame(rows, "s string, id string, v double")


def brute_draw(rows, sizes, seed):
    seen = Counter()
    keyed = []
    for s, i, v in sorted(rows, key=str):
        copy = seen[(s, i, v)]
        seen[(s, i, v)] += 1
        rendered = "NA" if v is None else f"{v:.9f}"
        text = f"{seed}:{'NA' if i is None else i}:{rendered}:{copy}"
        keyed.append((s, hashlib.md5(text.encode()).hexdigest(), i, v))
    out = []
    for name, n in sizes.items():
        out += [(s, i, v) for s, _, i, v in sorted(k for k in keyed if k[0] == name)[:n]]
    return Counter(out)


def test_draw_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), str(rng.randrange(400)), rng.randrange(3) / 4) for _ in range(3000)]
    sizes = {"a": 300, "b": 7}
    drawn = draw(stratified(spark, rows), ["id", "v"], sizes, 9, "s")
    assert Counter(tuple(r) for r in drawn.collect()) == brute_draw(rows, sizes, 9)


@pytest.mark.parametrize("ranked_rows", [1, 40, 1_000])
def test_large_samples_rank_few_rows(spark, ranked_rows):
    rows = [(("a", "b", "c")[i % 3 and 1 + i % 2], str(i), i % 5 / 4) for i in range(9_000)]
    sizes = {"a": 1_000, "b": 2_999, "c": 0}
    drawn = draw(stratified(spark, rows), ["id", "v"], sizes, 9, "s", ranked_rows=ranked_rows)
    assert Counter(tuple(r) for r in drawn.collect()) == brute_draw(rows, sizes, 9)


def test_sample_of_a_third_of_the_frame_ranks_few_rows(spark):
    frame = spark.range(120_000).select(F.lit("a").alias("s"), F.col("id").cast("string").alias("id"))
    drawn = draw(frame, ["id"], {"a": 40_000}, 9, "s", ranked_rows=500)
    drawn.write.format("noop").mode("overwrite").save()
    assert drawn.count() == 40_000 == drawn.distinct().count()
    # Only rows of the last range reach the window: its filter is on whole prefixes.
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "StartsWith" in plan.split("Window")[1]
    ranked = drawn._jdf.queryExecution().optimizedPlan()
    window = [n for n in _nodes(ranked) if n.nodeName() == "Window"]
    below = window[0].children().head()
    from pyspark.sql import DataFrame

    session = spark._jsparkSession
    fed = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, below)
    assert 0 < DataFrame(fed, spark).count() <= 500


def _nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def test_copies_are_drawn_one_by_one(spark):
    rows = [("a", "hot", 1.0)] * 4000 + [("a", str(i), 1.0) for i in range(4000)]
    sizes = {"a": 1000}
    df = stratified(spark, rows)
    drawn = draw(df, ["id", "v"], sizes, 3, "s", copies_per_block=64).collect()
    assert Counter(tuple(r) for r in drawn) == brute_draw(rows, sizes, 3)
    share = sum(r.id == "hot" for r in drawn) / 1000
    assert 0.4 < share < 0.6  # half of the rows, half of the sample


def test_draw_ignores_layout(spark):
    rows = [("a", str(i % 500), None if i % 7 == 0 else i % 3 + 0.5) for i in range(2000)]
    df = stratified(spark, rows)
    results = set()
    for parts, shuffles in ((1, "1"), (7, "8"), (40, "50")):
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        drawn = draw(df.orderBy(F.rand(parts)).repartition(parts), ["id", "v"], {"a": 100}, 4, "s")
        results.add(tuple(sorted(str(tuple(r)) for r in drawn.collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(results) == 1


def test_strictness(spark):
    df = stratified(spark, [("a", "1", 1.0), ("a", "2", 1.0), ("b", "3", 1.0)])
    with pytest.raises(SampleTooLarge):
        draw(df, ["id"], {"a": 3}, 1, "s")
    with pytest.raises(SampleTooLarge):
        draw(df, ["id"], {"a": 1, "empty": 1}, 1, "s")
    assert draw(df, ["id"], {"a": 3, "b": 1}, 1, "s", strict=False).count() == 3
    assert draw(df, ["id"], {"a": 0, "empty": 4}, 1, "s", strict=False).count() == 0


# -- samples -----------------------------------------------------------------------


def frame(spark, numbers):
    rows = [(f"{i}_AMI", None if n is None else float(n)) for i, n in enumerate(numbers)]
    return spark.createDataFrame(rows, "item_id string, metered_savings double")


def test_strata_and_bins_disagree_on_break_points(spark):
    df = frame(spark, [-1, 0, 1, 2, 3, 4, None])
    breaks = samples.quartile_breaks(df)
    assert breaks == [0.0, 1.0, 2.0, 3.0, 4.0]
    out = df.select(
        "metered_savings",
        samples.sampling_stratum(breaks).alias("stratum"),
        samples.checking_bin(breaks).alias("bin"),
    )
    assert {r[0]: (r[1], r[2]) for r in out.collect()} == {
        -1.0: ("NEG", None),
        0.0: ("Q1", "Q1"),
        1.0: ("Q2", "Q1"),
        2.0: ("Q3", "Q2"),
        3.0: ("Q4", "Q3"),
        4.0: ("Q4", "Q4"),
        None: (None, None),
    }


def test_equal_breaks_raise(spark):
    with pytest.raises(ValueError, match="unique"):
        samples.checking_bin([0.0, 0.0, 1.0, 2.0, 3.0])


def test_stratified_sample(spark):
    rng = random.Random(2)
    df = frame(spark, [rng.gauss(1, 2) for _ in range(2000)])
    sample = samples.stratified_sample(df, n_negative=50, n_per_quartile=80, seed=1)
    counts = {r.stratum: r["count"] for r in sample.rows.groupBy("stratum").count().collect()}
    assert counts == {"NEG": 50, "Q1": 80, "Q2": 80, "Q3": 80, "Q4": 80}
    ids = [r.item_id for r in sample.ids().collect()]
    assert len(set(ids)) == len(ids) == 370
    assert sample.rows.join(df, ["item_id", "metered_savings"], "left_anti").isEmpty()
    other = samples.stratified_sample(df, n_negative=50, n_per_quartile=80, seed=2)
    assert set(ids) != {r.item_id for r in other.ids().collect()}
    with pytest.raises(SampleTooLarge):
        samples.stratified_sample(df, n_negative=50, n_per_quartile=2000)


def test_simple_sample(spark):
    df = frame(spark, range(100))
    assert samples.simple_sample(df, 30).count() == 30
    assert samples.simple_sample(df, 1000).count() == 100


def test_sample_check_lists_empty_bins(spark):
    df = frame(spark, [-5.0, -4.0, 0.0, 1.0, 2.0, 3.0, 4.0])
    some = df.filter("metered_savings in (-4.0, 4.0)").withColumn("stratum", F.lit("?"))
    check = samples.sample_check(samples.Sample(some, [0.0, 1.0, 2.125, 3.0, 4.0]))
    assert [tuple(r) for r in check.collect()] == [
        ("negatives", "NEG", 1.0),
        ("rows_in_bin", "Q1", 0.0),
        ("rows_in_bin", "Q2", 0.0),
        ("rows_in_bin", "Q3", 0.0),
        ("rows_in_bin", "Q4", 1.0),
        ("break", "0%", 0.0),
        ("break", "25%", 1.0),
        ("break", "50%", 2.12),
        ("break", "75%", 3.0),
        ("break", "100%", 4.0),
    ]


def test_rows_without_savings_are_not_drawn(spark):
    numbers = [float(i) for i in range(-20, 80)]
    sample = samples.stratified_sample(frame(spark, numbers + [float("nan")] * 30), 5, 5)
    assert sample.breaks == [0.0, 19.75, 39.5, 59.25, 79.0]
    assert not any(r.metered_savings != r.metered_savings for r in sample.rows.collect())


# -- sketches ----------------------------------------------------------------------


def sketched(spark, numbers, parts=7):
    rows = [(i % parts, None if n is None else float(n)) for i, n in enumerate(numbers)]
    frame = spark.createDataFrame(rows, "part int, x double")
    return frame, quantile_sketches.sketch_table(frame, "x", ["part"])


@pytest.mark.parametrize("name", ["spread", "hot", "constant", "one", "outliers"])
def test_sketched_quantiles_are_close_in_rank(spark, name):
    numbers = number_sets()[name] * 5
    frame, sketches = sketched(spark, numbers + [None, float("nan")])
    row = quantile_sketches.sketched_quantiles(sketches, PROBS).first()
    assert row["n"] == len(numbers)
    ordered = sorted(numbers)
    for p, x in zip(PROBS, row["quantiles"]):
        low, high = bisect.bisect_left(ordered, x), bisect.bisect_right(ordered, x)
        slack = quantile_sketches.RANK_ERROR
        assert low / len(ordered) - slack <= p <= high / len(ordered) + slack
        assert x in ordered
    checked = quantile_sketches.rank_check(frame, "x", PROBS, row["quantiles"])
    assert {r["close"] for r in checked.collect()} == {True}
    wrong = quantile_sketches.rank_check(frame, "x", [0.5], [ordered[-1] + 1])
    assert wrong.first()["close"] is False


def test_sketches_of_new_parts_join_the_old(spark):
    old = sketched(spark, range(20_000))[1]
    new = sketched(spark, range(20_000, 40_000), parts=3)[1]
    row = quantile_sketches.sketched_quantiles(old.union(new), [0.0, 0.5, 1.0]).first()
    assert row["n"] == 40_000
    assert row["quantiles"][0] == 0 and row["quantiles"][2] == 39_999
    assert abs(row["quantiles"][1] - 20_000) <= 40_000 * quantile_sketches.RANK_ERROR


def test_sketch_of_nothing(spark):
    for numbers in ([], [None, None]):
        row = quantile_sketches.sketched_quantiles(sketched(spark, numbers)[1], [0.5]).first()
        assert (row["n"], row["quantiles"]) == (0, None)
