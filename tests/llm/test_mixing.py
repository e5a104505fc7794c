import pytest
from pyspark.sql import functions as F

from gridtally.llm import mixing
from gridtally.llm.common import word_count

SIZED = "doc_id long, source string, size long"


def _targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Deals out by weight, cuts at the limit and deals out again, until nothing is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        dealt = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if dealt[s] > most * sizes[s]]
        if not over:
            return {**fixed, **dealt}
        fixed.update({s: most * sizes[s] for s in over})


def test_targets_and_shares(spark):
    names = ["a", "b", None, "c", "hot"]
    rows = [(i, names[i % 5] if i % 3 else "hot", (i * 7) % 23) for i in range(3000)]
    out = mixing.mix(spark.createDataFrame(rows, SIZED)).collect()
    sizes, taken, target = {}, {}, {}
    for r in out:
        source = r.doc.source
        sizes[source] = sizes.get(source, 0) + r.size
        taken[source] = taken.get(source, 0) + r.taken
        target[source] = r.target
        assert r.taken in (0, r.size, 2 * r.size)
    assert len(out) == 3000
    assert all(r.source_size == sizes[r.doc.source] for r in out)
    assert target == pytest.approx(_targets(sizes))
    for source in sizes:
        assert abs(taken[source] - target[source]) <= 2 * 22
    assert 1.5 * sum(sizes.values()) - sum(taken.values()) <= 22 * 5


def test_budget_is_never_passed_and_reruns_agree(spark):
    rows = [(i // 2, "xyz"[i % 3], 5) for i in range(100)]
    frame = spark.createDataFrame(rows, SIZED)
    first = sorted(map(tuple, mixing.mix(frame).select("doc.doc_id", "size", "taken").collect()))
    again = sorted(
        map(tuple, mixing.mix(frame.repartition(5)).select("doc.doc_id", "size", "taken").collect())
    )
    assert first == again
    assert sum(r[2] for r in first) <= 750


def test_edges(spark):
    assert mixing.mix(spark.createDataFrame([], SIZED)).collect() == []
    empty = mixing.mix(spark.createDataFrame([(1, "a", 0), (None, None, None)], SIZED)).collect()
    assert [(r.size, r.target, r.taken) for r in empty] == [(0, 0.0, 0)] * 2
    clash = spark.createDataFrame(
        [(1, "a", 3, "x", "y"), (2, "b", 3, "x", "y")],
        f"{SIZED}, taken string, source_key string",
    )
    for in_order in (True, False):
        out = mixing.mixed(clash, in_order=in_order)
        assert out.columns == clash.columns
        assert out.count() == 3


def test_sources_that_finish_together_are_served_one_by_one(spark):
    rows = [(i, f"s{i:02}", 100) for i in range(60)]
    out = mixing.mix(spark.createDataFrame(rows, SIZED), weights=(1,)).collect()
    assert sum(r.taken for r in out) == 9_000
    again = mixing.mix(spark.createDataFrame(rows[::-1], SIZED).repartition(3), weights=(1,)).collect()
    assert {(r.doc.doc_id, r.taken) for r in out} == {(r.doc.doc_id, r.taken) for r in again}
    weighed = mixing.mix(spark.createDataFrame(rows, SIZED)).collect()
    assert sum(r.taken for r in weighed) >= 8_900


@pytest.mark.parametrize("block", [1_000, 7])
def test_rows_without_id_and_repeated_rows_spread(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "COPIES_PER_BLOCK", block)
    rows = [(None, "a", 3)] * 3_000 + [(5, "a", 3)] * 500 + [(i, "b", 3) for i in range(500)]
    frame = spark.createDataFrame(rows, SIZED)
    numbered = mixing._numbered(frame)
    assert numbered.count() == 4_000 == numbered.distinct().count()
    key = mixing.shuffle_key(F.col("doc"), frame.columns, F.col("copy"), 7)
    keys = numbered.select(key.alias("key"), F.shiftright(key, mixing.KEY_BITS - mixing.BUCKET_BITS).alias("b"))
    assert keys.select("key").distinct().count() == 4_000
    assert keys.groupBy("b").count().agg(F.max("count")).first()[0] < 10
    out = mixing.mix(frame).collect()
    assert len(out) == 4_000
    assert sum(r.taken for r in out) == pytest.approx(1.5 * 12_000, abs=6)


def test_rows_of_one_id_that_differ_elsewhere_have_keys_of_their_own(spark):
    rows = [(1, "a", 3, f"text {i}") for i in range(200)]
    frame = spark.createDataFrame(rows, f"{SIZED}, text string")
    key = mixing.shuffle_key(F.col("doc"), frame.columns, F.col("copy"), 7)
    assert mixing._numbered(frame).select(key).distinct().count() == 200
    assert {r.doc.text for r in mixing.mix(frame).collect()} == {r[3] for r in rows}


def test_word_count(spark):
    texts = ["a b", "  a\tb ", "", " ", None, "a", "\n\xa0x\n", "x" * 5000]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = [r[0] for r in frame.select(word_count(F.col("text"))).collect()]
    assert counts == [2, 2, 0, 0, 0, 1, 1, 1]
