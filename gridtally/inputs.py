"""Projections of the shared test tables into the shapes the plans expect.

Each function reads one table of a folder and reshapes its columns; row counts
grow with the table. The rules are written down in ``FIXTURES.md``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtally.functions import clock
from gridtally.plans import event_savings

# Events per document at most, so that assembling one is bounded work.
EVENTS_PER_DOCUMENT = 5_000

# Some orders with negative savings stand for customers that are listed very often.
REPEATED, REPEATS = "o_orderkey < 12 and o_totalprice < 100000", 2_500

# Savings far from all others: sums must neither lose them nor what is next to them.
HUGE, TINY = "event_id % 397 = 3", "event_id % 397 in (5, 6)"
ENDLESS = "event_type = 'signup' and event_id % 397 = 9"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def savings(spark: SparkSession, folder: str) -> DataFrame:
    """Meter-hour savings; ``initial_export`` marks superseded rows."""
    events = table(spark, folder, "events").selectExpr(
        "if(event_id % 997 = 0, null, concat(user_id, '_AMI')) as item_id",
        """case event_type when 'click' then 'Event 1' when 'view' then 'Event 2'
             when 'purchase' then 'Event 3' when 'signup' then 'Event 4'
             else concat('Event ', event_id % 4 + 1) end as event""",
        "event_type = 'error' as initial_export",
        "cast(ts as timestamp_ntz) as ts",
        f"""case when event_id % 101 = 0 then null when {HUGE} then 1e13D
             when {TINY} then 3e-10D when {ENDLESS} then double('Infinity')
             else round(value - 30.0D, 2) end as metered_savings""",
        "if(event_id % 53 = 0, null, event_id % 7 = 0) as non_responsive",
    )
    return events.withColumn("timestamp", clock.hour_floor(F.col("ts"))).drop("ts")


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with event flags; some are listed twice and a few disagree."""
    numbered = table(spark, folder, "customer").selectExpr(
        "*", "explode(if(c_custkey % 83 = 0, array(0, 1), array(0))) as k"
    )
    return numbered.selectExpr(
        "cast(c_custkey as string) as customer_id",
        """case when c_custkey % 13 = 0 then null
             when c_mktsegment in ('BUILDING', 'MACHINERY', 'HOUSEHOLD') then 'Yes'
             else 'No' end as event1_in_info""",
        "if(c_nationkey % 3 = 0, 'No', 'Yes') as event2_in_info",
        """case when c_custkey % 11 = 0 then null when c_acctbal < 3000 then 'No'
             else 'Yes' end as event3_in_info""",
        "if(c_nationkey % 5 = 0 and k = 0, 'No', 'Yes') as event4_in_info",
    )


def drop_lists(spark: SparkSession, folder: str) -> list[DataFrame]:
    """Four overlapping lists of meters to disqualify."""
    suppliers = table(spark, folder, "supplier")
    listed = (
        "s_nationkey % 4 = 0 and s_suppkey % 3 = 0",
        "s_nationkey % 4 = 1 and s_suppkey % 3 = 0",
        "s_suppkey % 9 = 0 and s_suppkey % 2 = 0",
        "s_suppkey % 9 = 0 and s_suppkey % 2 = 1",
    )
    raw = "concat(s_suppkey, '_AMI') as meter_raw"
    return [suppliers.filter(condition).selectExpr(raw) for condition in listed]


def savings_clean(spark: SparkSession, folder: str) -> DataFrame:
    updated = savings(spark, folder).filter("not initial_export")
    return event_savings.savings_clean(
        updated,
        event_savings.customer_flags(customers(spark, folder)),
        event_savings.drop_list(*drop_lists(spark, folder)),
    )


def reads(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly reads in UTC parts; some sites always read the same, so totals are shared."""
    return table(spark, folder, "lineitem").selectExpr(
        "cast(l_partkey as string) as account_id",
        "year(l_shipdate) as year",
        "month(l_shipdate) as month",
        "day(l_shipdate) as day",
        "cast(l_quantity as int) % 24 as hour",
        """if(l_orderkey % 211 = 0, null,
             if(l_partkey % 7 = 0, 0.125D, l_extendedprice / 10000.0D)) as kwh""",
    )


def sites(spark: SparkSession, folder: str) -> DataFrame:
    """Sites to analyse, one of which has no reads."""
    listed = table(spark, folder, "part").filter("p_size % 4 = 0")
    extra = spark.range(1).selectExpr("'missing_site' as model_id")
    return listed.selectExpr("cast(p_partkey as string) as model_id").union(extra)


def frame(spark: SparkSession, folder: str) -> DataFrame:
    """Sampling frame: customers with savings of either sign, some of them listed very often."""
    listed = table(spark, folder, "orders").selectExpr(
        "*", f"explode(sequence(1, if({REPEATED}, {REPEATS}, 1))) as k"
    )
    return listed.selectExpr(
        "concat(o_orderkey, '_AMI') as item_id",
        "(o_totalprice - 100000.0D) / 1000.0D as metered_savings",
    )


def vendor(spark: SparkSession, folder: str) -> DataFrame:
    """Vendor estimates; some sites are absent, some listed twice."""
    listed = table(spark, folder, "customer").filter("c_custkey % 5 <> 1")
    repeated = listed.selectExpr(
        "*", "explode(if(c_custkey % 83 = 0, array(0, 1), array(0))) as k"
    )
    return repeated.selectExpr(
        "concat(c_custkey, '_AMI') as item_id", "c_acctbal / 10.0D as metered_savings"
    )


def model_documents(spark: SparkSession, folder: str) -> DataFrame:
    """JSON model outputs as ``file_name, text``, assembled from the events of a user.

    Some values are no numbers, some times are none, and some documents are broken. Sites
    that the vendor lacks have a few values far from all others.

    A user's events are cut into runs by event number, one document per run, all
    under the user's file name as if in separate folders: however active a user
    is, no document holds more than ``EVENTS_PER_DOCUMENT`` events.
    """
    entries = table(spark, folder, "events").selectExpr(
        "user_id",
        f"event_id div {EVENTS_PER_DOCUMENT} as run",
        r"""concat('"', case event_id % 1013
                when 7 then concat('unknown ', event_id)
                when 8 then date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS'+00:00'")
                when 9 then date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS 'Etc/UTC'")
                else date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") end, '":',
              if(event_id % 101 = 0, 'null', case event_id % 1009
                when 1 then '"NaN"' when 2 then '1e999' when 3 then '"3d"'
                when 4 then '"text"' when 5 then '[1]'
                else case when user_id % 5 <> 1 then cast(value as string)
                  when event_id % 1013 = 11 then '1e13' when event_id % 1013 = 12 then '3e-10'
                  else cast(value as string) end end)) as entry""",
    )
    grouped = entries.groupBy("user_id", "run").agg(
        F.concat_ws(",", F.collect_list("entry")).alias("entries")
    )
    return grouped.selectExpr(
        "concat('metered_savings_', user_id, '.txt') as file_name",
        """case when user_id % 29 = 28 then '{bad'
             when user_id % 31 = 30 then concat('{"metered_savings":{', entries, '}} junk')
             when user_id % 37 = 36 then concat('{"metered_savings":{', entries, '}}{"a":1}')
             when user_id % 41 = 40 then '  '
             when user_id % 43 = 42 then concat('[{', entries, '}]')
             when user_id % 47 = 46 then '{"metered_savings":[1,2]}'
             when user_id % 53 = 52 then concat('metered_savings = ', user_id)
             when user_id % 2 = 0 then concat('{"data":{"metered_savings":{', entries, '}}}')
             else concat('{"metered_savings":{', entries, '}}') end as text""",
    )


def unknown_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of unknown shape: a few fields of several types, not all in every one."""
    return table(spark, folder, "events").selectExpr(
        """concat(substring(props, 1, length(props) - 1), ', "site": "', user_id, '"',
             if(event_id % 3 = 0, ', "checked": true', ''), '}') as text"""
    )


def hourly_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Model outputs of unknown shape: single values, objects, lists, and a field of two types."""
    return table(spark, folder, "events").selectExpr(
        "event_id",
        """concat('{"site":"', user_id, '","model":{"r2":', round(value / 100, 4),
             ',"fit":{"name":"', event_type, '"}},"hour":[0,1,2],"load":[', value, ',',
             if(event_id % 4 = 0, 'null', cast(event_id as string)), '],"tag":',
             if(event_id % 2 = 0, cast(event_id as string), '"odd"'),
             if(event_id % 3 = 0, ',"checked":true', ''), '}',
             if(event_id % 19 = 18, '{}', '')) as text""",
    )


def updated_exports(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """One export per event; that of event 3 lacks a column."""
    updated = savings(spark, folder).filter("not initial_export").drop("initial_export")
    exports = {e: updated.filter(F.col("event") == e) for e in event_savings.EVENT_FLAGS}
    return {**exports, "Event 3": exports["Event 3"].drop("non_responsive")}
