"""Event savings: eligibility flags, interval tables and count reconciliation.

Input is one row per meter and event hour. :func:`savings_clean` attaches the
flags and labels; every table below reads its result. Run several tables over a
written copy of it (``gridtally.jobs`` does), a single one straight from the
sources.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtally.functions import clock, exact, missing
from gridtally.functions.ids import meter_id
from gridtally.operators.exact_sums import binned_sums, exact_sums, gathered, or_zero, strict
from gridtally.operators.joins import flag_members, left_join

# Event labels and the customer flag that belongs to each.
EVENT_FLAGS = {
    "Event 1": "event1_in_info",
    "Event 2": "event2_in_info",
    "Event 3": "event3_in_info",
    "Event 4": "event4_in_info",
}
IN_INFO = "Yes"

# MW totals are kWh totals times ten to this power: single values divided by 1,000 carry
# rounding errors into their sum.
KWH_IN_MW = -3


# -- preparation ---------------------------------------------------------------


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Stack frames by column name; a column a frame lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_events(exports: Mapping[str, DataFrame]) -> DataFrame:
    """Stack one export per event, labelled with its event."""
    return union_by_name(*[df.withColumn("event", F.lit(e)) for e, df in exports.items()])


def customer_flags(customers: DataFrame) -> DataFrame:
    """Distinct customer ids with their event flags.

    A customer whose repeated rows disagree keeps one row per version, and its
    savings rows multiply in the join. ``flag_fanout`` lists such customers.
    """
    return customers.select("customer_id", *EVENT_FLAGS.values()).distinct()


def flag_fanout(customers: DataFrame) -> DataFrame:
    """Customers that multiply savings rows, with the number of flag versions."""
    versions = customer_flags(customers).groupBy("customer_id")
    return versions.agg(F.count(F.lit(1)).alias("n_versions")).filter("n_versions > 1")


def drop_list(*lists: DataFrame) -> DataFrame:
    """Distinct meters to disqualify, from lists with a ``meter_raw`` id each."""
    stacked = union_by_name(*lists)
    return stacked.select(meter_id(F.col("meter_raw")).alias("meter_id")).distinct()


def savings_clean(
    savings: DataFrame,
    flags: DataFrame,
    dropped: DataFrame,
    zone: str = clock.DENVER,
) -> DataFrame:
    """Savings rows with meter id, flags, local time, interval and activity label.

    ``savings``: ``item_id, event, timestamp`` (UTC), ``metered_savings`` (kWh),
    ``non_responsive``. ``flags`` as from :func:`customer_flags`, ``dropped`` as
    from :func:`drop_list`.

    All four flags ride along in one join on the meter, and the row's event picks
    its own: one exchange of the savings serves this join and the next, and the
    customer list is read once instead of once per event.
    """
    kwh = exact.nan_to_null(F.col("metered_savings"))
    local = clock.utc_to_local(F.col("timestamp"), zone)
    rows = savings.select(
        meter_id(F.col("item_id")).alias("meter_id"),
        "event",
        missing.sign_label(kwh).alias("customer_activity"),
        "timestamp",
        local.alias("colorado_time"),
        clock.hour_interval(local).alias("interval"),
        kwh.alias("savings_kwh"),
        (kwh / 1000).alias("savings_mw"),
        "non_responsive",
    )
    flagged = left_join(rows, flags.withColumnRenamed("customer_id", "meter_id"), ["meter_id"])
    marked = flag_members(flagged, dropped, "meter_id", "bad_meter")
    return marked.select(
        "meter_id",
        "event",
        "customer_activity",
        "timestamp",
        "colorado_time",
        "interval",
        "savings_kwh",
        "savings_mw",
        _own_flag().alias("in_event_info"),
        "non_responsive",
        "bad_meter",
    )


def _own_flag() -> Column:
    """Whether the row's customer is listed for the row's event; unknown stays NULL."""
    pairs = [(F.col("event") == event, F.col(flag)) for event, flag in EVENT_FLAGS.items()]
    first, *rest = pairs
    chosen = reduce(lambda chain, pair: chain.when(*pair), rest, F.when(*first))
    return chosen == IN_INFO


def _eligible(clean: DataFrame) -> DataFrame:
    return clean.filter(~F.col("bad_meter") & F.col("in_event_info"))


def _rounded_mw(name: str) -> Column:
    """An exact kWh total in MW, at two places; 0 where no row counted."""
    return or_zero(exact.rounded(F.col(name), 2, KWH_IN_MW)).alias(name)


# -- tables --------------------------------------------------------------------


def export_totals(clean: DataFrame) -> DataFrame:
    """Event totals of raw exports: rows and kWh per event."""
    totals = exact_sums(
        clean,
        ["event"],
        F.col("metered_savings"),
        {"total_kwh": None},
        {"n_rows": F.count(F.lit(1))},
    )
    total = or_zero(exact.to_double(F.col("total_kwh")))
    return totals.select("event", "n_rows", total.alias("total_kwh"))


def site_export(clean: DataFrame, event: str = "Event 1") -> DataFrame:
    """Positive savings of one event per meter and flag set (unknown flags included)."""
    keys = ["meter_id", "in_event_info", "non_responsive", "bad_meter"]
    positive = clean.filter((F.col("event") == event) & (F.col("savings_kwh") > 0))
    # A positive value is never unknown, so neither is the total.
    totals = exact_sums(positive, keys, F.col("savings_kwh"), {"savings_kwh": None})
    return totals.withColumn("savings_kwh", exact.to_double(F.col("savings_kwh")))


def _by_row_sign(clean: DataFrame) -> DataFrame:
    """Rounded MW by the sign of each row, and response counts, per event and interval."""
    kwh, responsive = F.col("savings_kwh"), ~F.col("non_responsive")
    totals = exact_sums(
        _eligible(clean),
        ["event", "interval"],
        kwh,
        {
            "mw_reduction_active": (kwh > 0) & responsive,
            "mw_reduction_inactive": (kwh < 0) & responsive,
        },
        {
            "n_active": F.count_if(responsive),
            "n_inactive": F.count_if(F.col("non_responsive")),
        },
    )
    return totals.select(
        "event",
        "interval",
        _rounded_mw("mw_reduction_active"),
        "n_active",
        _rounded_mw("mw_reduction_inactive"),
        "n_inactive",
    )


def interval_by_row_sign(clean: DataFrame) -> DataFrame:
    """MW per event and interval, split by the sign of each row; responsive rows only."""
    table = _by_row_sign(clean).drop("n_active", "n_inactive")
    return table.orderBy(*missing.nulls_last("event", "interval"))


def interval_keys(clean: DataFrame) -> DataFrame:
    """Event and interval pairs left after all filters (the table without its measures)."""
    return interval_by_row_sign(clean).drop("mw_reduction_active", "mw_reduction_inactive")


def _activity(clean: DataFrame) -> DataFrame:
    """Exact kWh of each meter and event, its rows and those that have a value."""
    return exact_sums(
        clean,
        ["meter_id", "event"],
        F.col("savings_kwh"),
        {"kwh": None},
        {"n": F.count(F.lit(1)), "n_known": F.count("savings_kwh")},
    )


def customer_activity(clean: DataFrame) -> DataFrame:
    """Savings and activity label per meter and event; one unknown hour makes both unknown."""
    total = strict("kwh", "n", "n_known")
    return _activity(clean).select(
        "meter_id",
        "event",
        exact.to_double(total, KWH_IN_MW).alias("total_event_activity"),
        missing.sign_label(exact.sign(total)).alias("activity_label"),
    )


def customer_activity_skipping_unknown(clean: DataFrame) -> DataFrame:
    """The same, with unknown hours left out of the total."""
    total = F.col("kwh")
    # Without any known hour the total is 0; infinities that cancel out are unknown.
    sign = F.when(total.isNull(), F.lit(0)).otherwise(exact.sign(total))
    mw = F.when(total.isNull(), F.lit(0.0)).otherwise(exact.to_double(total, KWH_IN_MW))
    return _activity(clean).select(
        "meter_id",
        "event",
        mw.alias("event_savings"),
        missing.sign_label(sign).alias("customer_activity"),
    )


def exact_by_event_label(clean: DataFrame) -> DataFrame:
    """Rounded MW per event and interval, split by the meter's label for the whole event.

    The label needs the meter's whole event, the table needs its intervals. Rows
    are first combined to one per meter, event, interval, flag set and bin of the exact
    sum, map-side where they repeat; the windows over a meter's event then see at most one
    day of intervals, however many rows the meter has. No second read of the input
    and no join back.
    """
    known = {"n": F.count(F.lit(1)), "n_known": F.count("savings_kwh")}
    flags = ["bad_meter", "in_event_info", "non_responsive"]
    keys = ["meter_id", "event", "interval", *flags]
    combined = binned_sums(clean, keys, F.col("savings_kwh"), {"kwh": None}, known)

    # The wider window first: one exchange serves both.
    whole_event = Window.partitionBy("meter_id", "event")
    bin_of_event = Window.partitionBy("meter_id", "event", "_bin")
    all_known = F.sum("n").over(whole_event) == F.sum("n_known").over(whole_event)
    sums = [F.sum(F.col("kwh")[limb]).over(bin_of_event).alias(limb) for limb in exact.LIMBS]
    in_bin = F.when(F.col("kwh").isNotNull(), F.struct(F.col("kwh")["bin"].alias("bin"), *sums))
    of_event = combined.withColumn("_known", all_known).withColumn("_in_bin", in_bin)
    # Rows of one bin carry the same sum, so the set holds one for each bin.
    bins = F.collect_set("_in_bin").over(whole_event)
    labelled = of_event.withColumn("_sign", exact.sign(F.when(F.col("_known"), bins)))

    responsive = ~F.col("non_responsive")
    label = missing.sign_label(F.col("_sign"))
    split = {"mw_reduction_active": "Active", "mw_reduction_inactive": "Inactive"}

    def limb_sums(name: str, activity: str) -> Column:
        mine = (label == activity) & responsive
        limbs = [F.sum(F.when(mine, F.col("kwh")[limb])).alias(limb) for limb in exact.LIMBS]
        total = F.struct(F.any_value("_bin").alias("bin"), *limbs)
        return F.when(F.count_if(mine & F.col("kwh").isNotNull()) > 0, total).alias(name)

    by_interval = (
        _eligible(labelled)
        .groupBy("event", "interval", "_bin")
        .agg(*[limb_sums(name, activity) for name, activity in split.items()])
    )
    totals = gathered(by_interval, ["event", "interval"], list(split))
    return totals.select("event", "interval", *map(_rounded_mw, split))


def interval_by_event_label(clean: DataFrame, exact_table: DataFrame | None = None) -> DataFrame:
    """MW per event and interval, split by the meter's label for the whole event.

    ``exact_table`` is that of :func:`exact_by_event_label`, if it is at hand.
    """
    table = exact_by_event_label(clean) if exact_table is None else exact_table
    return table.orderBy(*missing.nulls_last("event", "interval"))


def event_rounded_totals(clean: DataFrame, exact_table: DataFrame | None = None) -> DataFrame:
    """Per event, the sum of the *rounded* interval values (MW, despite the names)."""
    table = exact_by_event_label(clean) if exact_table is None else exact_table
    names = {"total_kwh_active": "mw_reduction_active", "total_kwh_inactive": "mw_reduction_inactive"}
    values = [
        F.struct(F.lit(name).alias("name"), F.col(column).alias("rounded_mw"))
        for name, column in names.items()
    ]
    long = table.select("event", F.inline(F.array(*values)))
    sums = {name: F.col("name") == name for name in names}
    totals = exact_sums(long, ["event"], F.col("rounded_mw"), sums)
    return totals.select("event", *[exact.to_double(F.col(name)).alias(name) for name in names])


def event_totals(clean: DataFrame) -> DataFrame:
    """Per event, all eligible MW and the number of distinct meters.

    ``mw_reduction_active`` counts every eligible row, whatever its activity; the
    name is kept from the report it is compared with. A meter is counted in the first
    bin of its exact sum, so one pass serves both columns; an unknown meter is one meter.
    """
    name = "mw_reduction_active"
    by_meter = binned_sums(
        _eligible(clean), ["event", "meter_id"], F.col("savings_kwh"), {name: None}
    )
    order = Window.partitionBy("event", "meter_id").orderBy(F.asc_nulls_first("_bin"))
    first = (F.row_number().over(order) == 1).cast("bigint")
    marked = by_meter.withColumn("total_participants", first)
    limbs = [F.sum(F.col(name)[limb]).alias(limb) for limb in exact.LIMBS]
    summed = F.struct(F.any_value("_bin").alias("bin"), *limbs)
    by_bin = marked.groupBy("event", "_bin").agg(
        F.when(F.count(name) > 0, summed).alias(name),
        F.sum("total_participants").alias("total_participants"),
    )
    totals = gathered(by_bin, ["event"], [name], ["total_participants"])
    table = totals.select("event", _rounded_mw(name), "total_participants")
    return table.orderBy(*missing.nulls_last("event"))


def response_counts(clean: DataFrame) -> DataFrame:
    """Responsive and non-responsive rows per event and interval.

    Named ``n_active`` and ``n_inactive`` after the report they are compared with.
    """
    table = _eligible(clean).groupBy("event", "interval").agg(
        F.count_if(~F.col("non_responsive")).alias("n_active"),
        F.count_if(F.col("non_responsive")).alias("n_inactive"),
    )
    return table.orderBy(*missing.nulls_last("event", "interval"))


def interval_combined(clean: DataFrame) -> DataFrame:
    """Row-sign MW next to the response counts.

    Both halves group the same rows by the same keys, so one aggregate computes
    them; a join of the two tables would return exactly this.
    """
    return _by_row_sign(clean).orderBy(*missing.nulls_last("event", "interval"))


# -- filter ladder -------------------------------------------------------------

# Names of the rungs; with each, which rows it keeps.
LADDER = {
    "badmeter": lambda: ~F.col("bad_meter"),
    "ineventinfo": lambda: F.col("in_event_info"),
    "nonresponsive": lambda: ~F.col("non_responsive"),
    "nofilters": lambda: F.lit(True),
}
ALL_FLAGS = "allflags"


def filter_ladder(clean: DataFrame, with_all_flags: bool = False) -> DataFrame:
    """Active and inactive rows per event and interval, applying one filter at a time.

    One pass counts every rung; the counts are then turned into one row per rung.
    A rung that keeps no row of a group has no row for it. ``with_all_flags`` adds
    a rung with all three filters together.
    """
    rungs = {name: keep() for name, keep in LADDER.items()}
    if with_all_flags:
        all_three = [rungs["badmeter"], rungs["ineventinfo"], rungs["nonresponsive"]]
        rungs[ALL_FLAGS] = reduce(lambda a, b: a & b, all_three)

    def counted(name: str, keep: Column) -> Column:
        activity = F.col("customer_activity")
        return F.struct(
            F.lit(name).alias("scenario"),
            F.count_if(keep).alias("n_rows"),
            F.count_if(keep & (activity == "Active")).alias("n_active"),
            F.count_if(keep & (activity == "Inactive")).alias("n_inactive"),
        )

    wide = clean.groupBy("event", "interval").agg(
        F.array(*[counted(name, keep) for name, keep in rungs.items()]).alias("rungs")
    )
    long = wide.select("event", "interval", F.inline("rungs")).filter("n_rows > 0")
    table = long.select("scenario", "event", "interval", "n_active", "n_inactive")
    return table.orderBy(*missing.nulls_last("scenario", "event", "interval"))
