"""Physical plans: no Python, no cross joins, pruned scans, split hot keys."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from gridtally import inputs, oracle
from gridtally.operators.joins import left_join, left_join_many
from gridtally.plans import event_savings


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    """Plan after running, as adaptive execution left it."""
    df.write.format("noop").mode("overwrite").save()
    rows = df.collect()
    return rows, plan_of(df)


@pytest.mark.parametrize("name", sorted(oracle.statements()))
def test_plans_stay_in_the_engine(spark, sf_small, name):
    plan = plan_of(entry_point.queries()[name](spark, sf_small))
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas", "Arrow"):
        assert forbidden not in plan


@pytest.mark.parametrize(
    "name", ["q_model_site_savings", "q_model_vs_vendor", "q_mean_abs_diff", "q_diff_histogram", "q_model_fit"]
)
def test_documents_are_parsed_once(spark, sf_small, name):
    plan = plan_of(entry_point.queries()[name](spark, sf_small))
    # The comparisons read the site totals, which are written before.
    assert plan.count("from_json") == (1 if name == "q_model_site_savings" else 0)
    assert scans(plan, "events") <= 1


def scans(plan, table):
    return len(re.findall(rf"FileScan parquet \[[^\n]*/{table}\.parquet", plan))


def test_tables_are_scanned_once(spark, sf_small):
    queries = entry_point.queries()
    for name in ("q_filter_ladder", "q_interval_eventlabel", "q_interval_combined"):
        plan = plan_of(queries[name](spark, sf_small))
        assert scans(plan, "events") == 1, name
        assert scans(plan, "customer") == 1, name
    for name, table in (
        ("q_reads_hour", "lineitem"),
        ("q_initial_union", "events"),
        ("q_site_coverage", "lineitem"),
        ("q_reads_distinct", "lineitem"),
        ("q_reads_distinct", "part"),
        ("q_site_coverage", "part"),
    ):
        assert scans(plan_of(queries[name](spark, sf_small)), table) == 1, name
    assert "Expand" not in plan_of(queries["q_reads_distinct"](spark, sf_small))


def test_scans_read_only_what_is_used(spark, sf_small):
    queries = entry_point.queries()
    plan = plan_of(queries["q_response_counts"](spark, sf_small))
    schema = re.search(r"events\.parquet\][^\n]*ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "value" not in schema and "props" not in schema
    plan = plan_of(queries["q_reads_dups"](spark, sf_small))
    schema = re.search(r"lineitem\.parquet\][^\n]*ReadSchema: struct<([^>]*)>", plan).group(1)
    assert set(re.findall(r"(\w+):", schema)) == {"l_partkey", "l_shipdate", "l_quantity"}


def files_read(df):
    """Files that the scans of a plan opened."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(node.plan())
        if name.startswith("Scan parquet"):
            total += node.metrics().apply("numFiles").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_extract_reads_the_folders_of_its_day(spark, tmp_path):
    import datetime as dt

    from gridtally.plans import meter_reads
    from gridtally.sources.sinks import write_table

    hours = spark.range(0, 24 * 366 * 6, 1, 4).selectExpr(
        "concat('site', id % 6) as id", "timestampadd(HOUR, id div 6, timestamp_ntz '2023-01-01') as t", "0.5D as kwh"
    )
    reads = hours.selectExpr("id", "year(t) as year", "month(t) as month", "day(t) as day", "hour(t) as hour", "kwh")
    timed = meter_reads.with_local_time(reads)
    stored = write_table(
        meter_reads.in_storage_order(timed), str(tmp_path / "reads"), *meter_reads.STORED_BY
    )
    whole = files_read(stored.groupBy("id").count())
    extract = meter_reads.hourly_extract(stored.drop("local"), ["site3"], dt.date(2023, 7, 15))
    few = files_read(extract)
    assert extract.count() == 24
    # The day and its neighbours in UTC lie in one month of thirteen.
    assert 0 < few <= whole / 6
    at_the_turn = meter_reads.hourly_extract(stored.drop("local"), ["site3"], dt.date(2023, 7, 31))
    assert at_the_turn.count() == 24 and files_read(at_the_turn) <= whole / 3
    assert re.search(r"PartitionFilters: \[[^\]]*year#", plan_of(extract))


def test_filters_reach_the_scan(spark, sf_small):
    plan = plan_of(entry_point.queries()["q_savings_clean"](spark, sf_small))
    assert re.search(r"PushedFilters: \[IsNotNull\(event_type\), Not\(EqualTo", plan)


def test_one_event_prunes_the_other_exports(spark):
    exports = {
        event: spark.createDataFrame([("1", 1.0)], "item_id string, savings_kwh double")
        for event in event_savings.EVENT_FLAGS
    }
    one = event_savings.union_events(exports).filter("event = 'Event 1'")
    assert plan_of(one).count("Scan ExistingRDD") == 1


@pytest.fixture()
def small_limits(spark):
    """Limits low enough that a few megabytes count as skew."""
    limits = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    before = {key: spark.conf.get(key, None) for key in limits}
    for key, value in limits.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def hot(spark, n, payload):
    """A third of the rows on one key."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string"))
    text = F.sha2(F.col("id").cast("string"), 256)
    return spark.range(0, n, 1, 8).select(key.alias("k"), text.alias(payload))


def test_hot_key_on_the_preserved_side_is_split(spark, small_limits):
    left = hot(spark, 60_000, "x")
    right = spark.createDataFrame([("hot", 1), ("7", 2)], "k string, y int")
    joined = left_join(left, right, ["k"])
    rows, plan = final_plan(joined.groupBy("y").agg(F.count("x").alias("n")))
    assert "skew=true" in plan
    assert {(r.y, r.n) for r in rows} == {(1, 20_000), (2, 1), (None, 39_999)}


def test_hot_key_on_the_looked_up_side_is_split(spark, small_limits):
    left = spark.range(0, 30_000, 1, 4).select(F.col("id").cast("string").alias("k"))
    left = left.union(spark.createDataFrame([("hot",)], "k string"))
    right = hot(spark, 60_000, "y")
    joined = left_join_many(left, right, ["k"])
    rows, plan = final_plan(joined.agg(F.count("*"), F.count("y")))
    assert "skew=true" in plan
    matched = 20_000 + 20_000  # the hot rows, and 0..29999 without multiples of three
    assert tuple(rows[0]) == (matched + 10_000, matched)


def test_results_do_not_depend_on_shuffle_width(spark, sf_small):
    queries = entry_point.queries()
    for name in ("q_interval_eventlabel", "q_customer_activity", "q_reads_month", "q_mean_abs_diff"):
        seen = set()
        for width in ("1", "7", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", width)
            rows = queries[name](spark, sf_small).collect()
            seen.add(tuple(sorted(str(tuple(r)) for r in rows)))
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert len(seen) == 1, name


def test_counts_add_up(spark, sf_small):
    queries = entry_point.queries()

    def n(name):
        return queries[name](spark, sf_small).agg(F.sum("n_observations")).first()[0]

    assert n("q_reads_month") == n("q_reads_day") == n("q_reads_hour")
    ladder = queries["q_filter_ladder"](spark, sf_small).collect()
    unfiltered = {(r.event, r.interval): r for r in ladder if r.scenario == "nofilters"}
    for r in ladder:
        everything = unfiltered[(r.event, r.interval)]
        assert r.n_active <= everything.n_active
        assert r.n_inactive <= everything.n_inactive


def test_document_size_is_bounded(spark, sf_small):
    events = inputs.table(spark, sf_small, "events")
    assert events.groupBy("event_id").count().filter("count > 1").isEmpty()
