"""Model outputs per site against the vendor's estimate."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtally.functions import clock, exact
from gridtally.functions.ids import meter_id, site_of_document
from gridtally.functions.numbers import number_from_text
from gridtally.operators.exact_sums import exact_sums, strict
from gridtally.operators.joins import left_join_many


def flatten(documents: DataFrame, zone: str = clock.DENVER) -> DataFrame:
    """One row per document, time and value.

    ``documents``: ``file_name`` and the ``savings`` map, as parsed; rejected
    documents have no map and give no rows. A JSON null counts as 0; a value that
    is no number is NULL and flagged ``unreadable``. A time that occurs twice in a
    document gives two rows.

    Empty maps are dropped after the explode. A filter on the document, written or
    inferred from an inner explode, would move below the parser and parse twice.
    """
    exploded = documents.select(
        "file_name", F.explode_outer("savings").alias("time_text", "value")
    )
    # Numbers are read in a step of their own, so that two columns can use them.
    pairs = exploded.filter("time_text is not null").withColumn(
        "number", number_from_text(F.col("value"))
    )
    utc = clock.utc_from_text(F.col("time_text"))
    value, number = F.col("value"), F.col("number")
    return pairs.select(
        site_of_document(F.col("file_name")).alias("id"),
        utc.alias("time_utc"),
        clock.utc_to_local(utc, zone).alias("time"),
        F.when(value.isNull(), F.lit(0.0)).otherwise(number).alias("savings"),
        (value.isNotNull() & number.isNull()).alias("unreadable"),
    )


def in_event_window(
    hourly: DataFrame, start: dt.datetime, end: dt.datetime, zone: str = clock.DENVER
) -> DataFrame:
    """Rows between two local times, both included, compared as instants.

    The two bounds move to UTC, once; the rows need no local time for this.
    """
    low, high = [
        clock.local_to_utc(F.lit(t.isoformat(" ")).cast("timestamp_ntz"), zone)
        for t in (start, end)
    ]
    return hourly.filter(F.col("time_utc").between(low, high))


def site_savings(hourly: DataFrame) -> DataFrame:
    """Modelled savings per site over all hours; an unreadable value makes them unknown."""
    counts = {"n": F.count(F.lit(1)), "n_known": F.count("savings")}
    sums = exact_sums(hourly, ["id"], F.col("savings"), {"total": None}, counts)
    total = exact.to_double(strict("total", "n", "n_known"))
    return sums.select("id", total.alias("model_metered_savings"))


def model_vs_vendor(modelled: DataFrame, vendor: DataFrame) -> DataFrame:
    """Every modelled site next to each vendor row of it, with the absolute difference.

    ``vendor``: ``item_id, metered_savings``. Sites the vendor lacks keep NULLs; a
    site the vendor lists several times gives several rows.
    """
    estimates = vendor.select(
        meter_id(F.col("item_id")).alias("id"),
        "item_id",
        exact.nan_to_null(F.col("metered_savings")).alias("vendor_estimation"),
    )
    joined = left_join_many(modelled, estimates, ["id"])
    gap = F.abs(F.col("model_metered_savings") - F.col("vendor_estimation"))
    return joined.select(
        F.col("item_id").alias("sample_id"),
        F.col("id").alias("model_id"),
        "vendor_estimation",
        F.col("model_metered_savings").alias("model_estimation"),
        gap.alias("absolute_savings_difference"),
    )


def mean_difference(compared: DataFrame) -> DataFrame:
    """Mean absolute difference: unknown if any site is unmatched, and over matches only."""
    gap = F.col("absolute_savings_difference")
    counts = {"n_rows": F.count(F.lit(1)), "n_matched": F.count(gap)}
    sums = exact_sums(compared, [], gap, {"total": None}, counts)
    mean = F.try_divide(exact.to_double(F.col("total")), F.col("n_matched"))
    return sums.select(
        F.when(F.col("n_rows") == F.col("n_matched"), mean).alias("mean_difference"),
        mean.alias("matched_mean_difference"),
        "n_rows",
        "n_matched",
    )


# Keeps a value that lies on a bin's upper edge in that bin despite rounding noise.
_EDGE_TOLERANCE = 1e-8


def difference_histogram(compared: DataFrame, width: float = 0.1) -> DataFrame:
    """Rows per bin of the absolute difference.

    Bins are centred on multiples of ``width`` and closed on the right, as a
    histogram plot draws them; rows without a difference are left out.
    """
    steps = F.col("absolute_savings_difference") / F.lit(width)
    # A double of 2 ** 53 and more is whole, and may be too large for an integer.
    near = F.ceil(steps - F.lit(0.5 + _EDGE_TOLERANCE)).cast("double")
    index = F.when(steps < F.lit(2.0**53), near).otherwise(steps)
    return (
        compared.filter("absolute_savings_difference is not null")
        .groupBy(index.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n_sites"))
        .withColumn("bin_center", F.col("bin") * F.lit(width))
    )


def linear_fit(compared: DataFrame) -> DataFrame:
    """Least-squares line of the model's estimate on the vendor's, unrounded."""
    y, x = "model_estimation", "vendor_estimation"
    return compared.agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_count(y, x).alias("n_sites"),
    )
