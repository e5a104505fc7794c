"""Hourly meter reads: local time, month/day/hour totals, duplicate checks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtally.functions import clock, exact, missing
from gridtally.operators.exact_sums import exact_sums, strict
from gridtally.operators.joins import flag_members, inner_join, semi_join

# Grains from coarse to fine; each adds one part of the local time.
GRAINS = {
    "month": ("year", "month"),
    "day": ("year", "month", "day"),
    "hour": ("year", "month", "day", "hour"),
}
PARTS = GRAINS["hour"]

# Registers of a distinct-count sketch: 2 ** 14 of them, a standard error of 0.8 %.
SKETCH_BITS = 14
# Three standard errors.
SKETCH_ERROR = 0.025


def reads_of_sites(reads: DataFrame, sites: DataFrame) -> DataFrame:
    """Reads of the listed sites as ``id, year, month, day, hour, kwh`` (still UTC).

    ``reads``: ``account_id``, the UTC time parts and ``kwh``; ``sites``: ``model_id``.
    """
    named = reads.select(
        F.col("account_id").alias("id"),
        *[F.col(part).cast("int").alias(part) for part in PARTS],
        exact.nan_to_null(F.col("kwh").cast("double")).alias("kwh"),
    )
    return semi_join(named, sites.withColumnRenamed("model_id", "id"), ["id"])


def with_local_time(site_reads: DataFrame, zone: str = clock.DENVER) -> DataFrame:
    """The same rows with their local wall clock, ``local``; unknown if the parts name no hour."""
    utc = clock.utc_from_parts(*[F.col(part) for part in PARTS])
    at_utc = site_reads.withColumn("utc", utc)
    return at_utc.withColumn("local", clock.utc_to_local(F.col("utc"), zone)).drop("utc")


def local_parts(timed: DataFrame) -> DataFrame:
    """Reads as ``id, year, month, day, hour, kwh`` of the local clock, from ``local``."""
    return timed.select(
        "id",
        F.year("local").alias("year"),
        F.month("local").alias("month"),
        F.dayofmonth("local").alias("day"),
        F.hour("local").alias("hour"),
        "kwh",
    )


def local_reads(site_reads: DataFrame, zone: str = clock.DENVER) -> DataFrame:
    """The same rows with the time parts of the local clock.

    Reads whose parts name no real hour keep their row with unknown parts.
    """
    return local_parts(with_local_time(site_reads, zone))


def read_totals(local: DataFrame, grain: str) -> DataFrame:
    """Observations and kWh per site and period; an unknown read makes the total unknown.

    Rows are combined before they move. The repeated wall-clock hour in autumn is one
    period.
    """
    counts = {"n_observations": F.count(F.lit(1)), "n_known": F.count("kwh")}
    return _strict_totals(local, grain, "kwh", counts)


def coarser_totals(totals: DataFrame, grain: str) -> DataFrame:
    """Totals of a coarser grain from those of a finer one, without the reads."""
    counts = {
        "n_observations": F.sum("n_observations"),
        "n_periods": F.count(F.lit(1)),
        "n_known": F.count("total_kwh"),
    }
    return _strict_totals(totals, grain, "total_kwh", counts, rows="n_periods")


def _strict_totals(
    frame: DataFrame, grain: str, value: str, counts: dict[str, Column], rows: str = "n_observations"
) -> DataFrame:
    keys = ["id", *GRAINS[grain]]
    sums = exact_sums(frame, keys, F.col(value), {"total_kwh": None}, counts)
    total = exact.to_double(strict("total_kwh", rows, "n_known"))
    return sums.select(*keys, "n_observations", total.alias("total_kwh"))


def in_time_order(totals: DataFrame, grain: str) -> DataFrame:
    """Sort by period, then site."""
    return totals.orderBy(*missing.nulls_last(*GRAINS[grain], "id"))


def distinct_readings(local: DataFrame, hours: DataFrame | None = None) -> DataFrame:
    """Distinct readings and sites per local hour, and readings per site.

    Both counts are over one row per hour and distinct value, so an hour with very
    many reads is not gathered in one task, and both kinds of value are told apart in
    one pass over the reads. ``hours`` are the hour totals, if they are at hand; they list
    the sites of each hour, so only the readings have to be counted.
    """
    wall = clock.utc_from_parts(*[F.col(part) for part in PARTS]).alias("timestamp")
    kwh, site = F.col("kwh"), F.col("id")
    counts = {"unique_kwh_readings": F.count_if(~F.col("is_site")), "unique_sites": F.count_if("is_site")}

    def values(*kinds: Column) -> Column:
        return F.inline(F.array(*kinds))

    def reading(value: Column) -> Column:
        return F.struct(F.lit(False).alias("is_site"), value.alias("kwh"), F.lit(None).cast("string").alias("id"))

    def place(value: Column) -> Column:
        return F.struct(F.lit(True).alias("is_site"), F.lit(None).cast("double").alias("kwh"), value.alias("id"))

    if hours is None:
        stacked = local.select(wall, values(reading(kwh), place(site)))
    else:
        stacked = local.select(wall, values(reading(kwh))).union(hours.select(wall, values(place(site))))
    distinct = stacked.distinct()
    counted = distinct.groupBy("timestamp").agg(*[c.alias(name) for name, c in counts.items()])
    ratio = F.try_divide("unique_kwh_readings", "unique_sites")
    return counted.withColumn("kwh_readings_per_site", ratio).orderBy(
        *missing.nulls_last("timestamp")
    )


def hour_sketches(local: DataFrame) -> DataFrame:
    """Sketches of the distinct readings and sites of each local hour, to be stored.

    A sketch has a few kilobytes at most, however many values it stands for, and two of
    them unite to that of both hours: see :func:`approximate_readings`. As in the exact
    counts, an unknown reading is a value like any other.
    """

    def sketched(column: str) -> Column:
        # A known value has something in front of it, so none looks like a missing one.
        text = F.concat(F.lit("="), F.col(column).cast("string"))
        return F.hll_sketch_agg(F.coalesce(text, F.lit("NA")), SKETCH_BITS)

    return local.groupBy(*PARTS).agg(
        F.count(F.lit(1)).alias("n_observations"),
        sketched("kwh").alias("readings"),
        sketched("id").alias("sites"),
    )


def approximate_readings(sketches: DataFrame, grain: str) -> DataFrame:
    """Distinct readings and sites per period, about, from stored hour sketches.

    Estimates are within ``SKETCH_ERROR`` of the exact counts for 99 of 100 periods, and
    almost exact for small ones. No read is looked at again.
    """
    keys = GRAINS[grain]
    united = sketches.groupBy(*keys).agg(
        F.sum("n_observations").alias("n_observations"),
        F.hll_sketch_estimate(F.hll_union_agg("readings")).alias("unique_kwh_readings"),
        F.hll_sketch_estimate(F.hll_union_agg("sites")).alias("unique_sites"),
    )
    ratio = F.try_divide("unique_kwh_readings", "unique_sites")
    return united.withColumn("kwh_readings_per_site", ratio)


def exact_readings(local: DataFrame, grain: str) -> DataFrame:
    """The exact counts that :func:`approximate_readings` estimates, from the reads."""
    keys = GRAINS[grain]

    def counted(column: str, name: str) -> DataFrame:
        distinct = local.select(*keys, column).distinct()
        return distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    readings = counted("kwh", "unique_kwh_readings")
    return inner_join(readings, counted("id", "unique_sites"), list(keys))


def approximation_check(local: DataFrame, sketches: DataFrame, grain: str) -> DataFrame:
    """Exact counts per period, and whether the estimates are within ``SKETCH_ERROR``."""
    keys = list(GRAINS[grain])
    names = ("unique_kwh_readings", "unique_sites")
    estimates = approximate_readings(sketches, grain).withColumnsRenamed({n: f"_{n}" for n in names})
    both = inner_join(exact_readings(local, grain), estimates, keys)

    def close(name: str) -> Column:
        error = F.abs(F.col(f"_{name}") - F.col(name)) / F.col(name)
        return (error <= SKETCH_ERROR).alias(f"{name}_close")

    return both.select(*keys, "n_observations", *names, *map(close, names))


def duplicate_reads(site_reads: DataFrame) -> DataFrame:
    """Site hours that occur more than once in the reads as delivered (UTC parts)."""
    counted = site_reads.groupBy("id", *PARTS).agg(F.count(F.lit(1)).alias("n"))
    return counted.filter("n > 1")


# How stored reads are laid out: a folder for each month (UTC), rows in order of sites.
STORED_BY = ("year", "month")


def in_storage_order(timed: DataFrame) -> DataFrame:
    """Reads dealt out for :data:`STORED_BY`: each task has a range of sites of few months.

    Rows are sorted inside it, so each file, and each row group in it, holds few sites. A
    site with very many reads in a month is cut by day and hour.
    """
    keys = [F.col(c).asc_nulls_last() for c in (*STORED_BY, "id", "day", "hour")]
    return timed.repartitionByRange(*keys).sortWithinPartitions(*keys)


def hourly_extract(
    site_reads: DataFrame, ids: Sequence[str], day: dt.date, zone: str = clock.DENVER
) -> DataFrame:
    """Hourly totals of a few sites on one local day.

    The ids reach the scan by themselves. The local day does not, so the UTC days
    it can touch are named as well, in terms of the stored parts. On reads stored
    :data:`STORED_BY` month and in order of sites, only the folders of that day's months
    are listed, and in them only row groups that may hold the ids are read.
    """
    around = [day + dt.timedelta(days=shift) for shift in (-1, 0, 1)]
    touched = F.lit(False)
    for utc_day in around:
        touched = touched | _on_day(utc_day)
    few = site_reads.filter(F.col("id").isin(*ids) & touched)
    return read_totals(local_reads(few, zone).filter(_on_day(day)), "hour")


def _on_day(day: dt.date) -> Column:
    return (
        (F.col("year") == day.year) & (F.col("month") == day.month) & (F.col("day") == day.day)
    )


def site_coverage(sites: DataFrame, site_reads: DataFrame) -> DataFrame:
    """How many listed sites have reads (``found``) and how many do not.

    Listed sites are counted before the join: a list that repeats a site counts
    each repetition but sends it once.
    """
    listed = sites.groupBy(F.col("model_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return (
        flag_members(listed, site_reads, "id", "found")
        .groupBy("found")
        .agg(F.sum("n").alias("n_sites"))
    )


def same_month_totals(local: DataFrame, places: int | None = None) -> DataFrame:
    """Sites that share an identical monthly total with another site.

    With ``places``, totals are identical if they print the same at that many
    decimals. Shared totals are counted first and joined back, one row per site:
    a total shared by very many sites is never gathered in one place.
    """
    sums = exact_sums(
        local,
        ["id", "year", "month"],
        F.col("kwh"),
        {"total": None},
        {"n": F.count(F.lit(1)), "n_known": F.count("kwh")},
    )
    known = sums.filter("n = n_known")
    kwh = exact.to_double(F.col("total")) if places is None else exact.rounded(F.col("total"), places)
    # Totals are compared as texts, which only equal numbers share.
    same = exact.to_text(F.col("total")) if places is None else kwh.cast("string")
    monthly = known.select("id", "year", "month", kwh.alias("total_kwh"), same.alias("same")).filter(
        "same is not null"
    )
    keys = ["year", "month", "same"]
    shared = monthly.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_sites")).filter("n_sites > 1")
    return inner_join(monthly, shared, keys).select("year", "month", "total_kwh", "id", "n_sites")
