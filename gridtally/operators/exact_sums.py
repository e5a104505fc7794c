"""Grouped sums of doubles that are exact, whatever the doubles.

Rows are grouped by their keys and by the bin of their value (:mod:`gridtally.functions.exact`)
and added limb by limb: integer sums, combined before the shuffle, so a hot group is a few
rows for each task. What is left, a row for each group and bin in use, is gathered by the
keys alone. A group has about a hundred bins at most, and almost always one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtally.functions import exact

_VALUE, _LIMBS = "_value", "_limbs"


def exact_sums(
    rows: DataFrame,
    keys: Sequence[str],
    value: Column,
    sums: Mapping[str, Column | None],
    counts: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``keys``, an exact total for each of ``sums`` and a bigint for each of ``counts``.

    A sum adds ``value`` over the rows that meet its condition, all rows if that is None;
    it is NULL where no such row has a value. ``counts`` are aggregates whose partial
    results can be added up, such as ``count``. Without keys the result is one row, also
    for an empty frame.
    """
    return gathered(binned_sums(rows, keys, value, sums, counts), keys, list(sums), list(counts or {}))


def binned_sums(
    rows: DataFrame,
    keys: Sequence[str],
    value: Column,
    sums: Mapping[str, Column | None],
    counts: Mapping[str, Column] | None = None,
) -> DataFrame:
    """The same before it is gathered: a row for each group and bin.

    Each sum is a struct of an exact total, NULL where the bin adds nothing to it.
    """
    # Steps of their own, so that the value and its limbs are computed once a row.
    with_limbs = rows.withColumn(_VALUE, value).withColumn(_LIMBS, exact.limbs(F.col(_VALUE)))
    bin_ = F.col(_LIMBS)["bin"]

    def parts(name: str, condition: Column | None) -> list[Column]:
        def added(limb: str) -> Column:
            digit = F.col(_LIMBS)[limb]
            return F.sum(digit if condition is None else F.when(condition, digit))

        return [added(limb).alias(f"_{name}_{limb}") for limb in exact.LIMBS]

    summed = with_limbs.groupBy(*keys, bin_.alias("_bin")).agg(
        *[part for name, condition in sums.items() for part in parts(name, condition)],
        *[count.alias(name) for name, count in (counts or {}).items()],
    )

    def struct(name: str) -> Column:
        limbs = [F.col(f"_{name}_{limb}").alias(limb) for limb in exact.LIMBS]
        return F.when(
            F.col(f"_{name}_l0").isNotNull(), F.struct(F.col("_bin").alias("bin"), *limbs)
        ).alias(name)

    return summed.select(*keys, "_bin", *map(struct, sums), *(counts or {}))


def gathered(
    binned: DataFrame, keys: Sequence[str], sums: Sequence[str], counts: Sequence[str] = ()
) -> DataFrame:
    """One row for each group: its sums over all bins, as exact totals, and its counts."""

    def total(name: str) -> Column:
        bins = F.collect_list(name)
        return F.when(F.size(bins) > 0, bins).alias(name)

    return binned.groupBy(*keys).agg(
        *map(total, sums), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts]
    )


def strict(total: str, rows: str, known: str) -> Column:
    """The total if no row lacked a value, else NULL. ``rows`` and ``known`` are counts."""
    return F.when(F.col(rows) == F.col(known), F.col(total))


def or_zero(number: Column) -> Column:
    """0 where there was nothing to add."""
    return F.coalesce(number, F.lit(0.0))
