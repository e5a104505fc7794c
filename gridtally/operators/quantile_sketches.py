"""Quantiles, about, from stored sketches.

:mod:`gridtally.operators.quantiles` reads the column a few times for exact answers. Where
those are not needed, one pass leaves a sketch of a few kilobytes for each part of a table;
sketches of any parts unite to that of their union, so new parts cost a pass over
themselves, and a question costs none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtally.functions.exact import nan_to_null

#: Size of a sketch, and the share of all rows by which the rank of an answer may be off.
SKETCH_SIZE = 2_000
RANK_ERROR = 0.002


def sketch_table(frame: DataFrame, column: str, parts: Sequence[str]) -> DataFrame:
    """``parts`` and a ``sketch`` of the column for each, to be stored; NaN counts as missing.

    A part whose values are all missing has a sketch of nothing.
    """
    value = nan_to_null(F.col(column).cast("double"))
    return frame.groupBy(*parts).agg(F.kll_sketch_agg_double(value, SKETCH_SIZE).alias("sketch"))


def sketched_quantiles(
    sketches: DataFrame, probabilities: Sequence[float], keys: Sequence[str] = ()
) -> DataFrame:
    """``keys``, ``n`` and ``quantiles``, an array, of all parts that share the keys.

    Each quantile is a value of the column whose rank is off by no more than ``RANK_ERROR``
    of the rows, in 99 of 100 cases; the smallest and the largest value are exact. Without
    values ``n`` is 0 and the quantiles are NULL.
    """
    united = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", SKETCH_SIZE).alias("sketch"))
    n = F.coalesce(F.kll_sketch_get_n_double("sketch"), F.lit(0).cast("long"))
    asked = F.array(*[F.lit(float(p)) for p in probabilities])
    counted = united.select(*keys, n.alias("n"), "sketch")
    found = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", asked))
    return counted.select(*keys, "n", found.alias("quantiles"))


def rank_check(
    frame: DataFrame, column: str, probabilities: Sequence[float], found: Sequence[float]
) -> DataFrame:
    """``probability, close``: whether the ranks of values are within ``RANK_ERROR`` of it."""
    value = nan_to_null(F.col(column).cast("double"))
    counts = [F.count(value).alias("n")]
    for i, x in enumerate(found):
        counts += [F.count_if(value < F.lit(x)).alias(f"below_{i}"), F.count_if(value <= F.lit(x)).alias(f"upto_{i}")]
    seen = frame.agg(*counts)

    def line(i: int, p: float):
        # A value that many rows share has all their ranks.
        low = F.col(f"below_{i}") / F.col("n") - F.lit(RANK_ERROR)
        high = F.col(f"upto_{i}") / F.col("n") + F.lit(RANK_ERROR)
        return F.struct(F.lit(p).alias("probability"), F.lit(p).between(low, high).alias("close"))

    return seen.select(F.inline(F.array(*[line(i, float(p)) for i, p in enumerate(probabilities)])))
