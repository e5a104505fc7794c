"""Joins in which NULL matches NULL, and set membership that is never NULL.

``<=>`` on plain columns is an equi-join key for Spark, so each join below is
planned as a broadcast, shuffled-hash or sort-merge join from measured sizes.
No broadcast is hinted: none of the lookup sides has a size bound of its own.
Beyond the broadcast threshold the join shuffles, and a hot key on the probing
side is split by adaptive execution (see ``gridtally.session``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RIGHT = "_lookup_"


def _keyed(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    """Right side with its keys renamed, and the null-safe condition."""
    renamed = right.withColumnsRenamed({key: _RIGHT + key for key in keys})
    terms = [left[key].eqNullSafe(renamed[_RIGHT + key]) for key in keys]
    return renamed, reduce(lambda a, b: a & b, terms)


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    renamed, condition = _keyed(left, right, keys)
    joined = left.join(renamed, condition, how)
    return joined.drop(*[_RIGHT + key for key in keys])


def inner_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Null-safe inner join.

    Also the form to use for keys that are costly to compute: a plain ``=`` makes
    the optimizer add not-null filters that compute them a second time.
    """
    return _join(left, right, keys, "inner")


def left_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Null-safe left join. Use where a key has few rows on the right."""
    return _join(left, right, keys, "left")


def semi_join(left: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose key occurs in ``members``."""
    return _join(left, members.select(*keys).distinct(), keys, "left_semi")


def flag_members(left: DataFrame, members: DataFrame, key: str, flag: str) -> DataFrame:
    """Add a boolean that is true where ``key`` occurs in ``members`` and never NULL."""
    marked = members.select(key).distinct().withColumn(flag, F.lit(True))
    joined = left_join(left, marked, [key])
    return joined.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def left_join_many(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Null-safe left join for a right side that may repeat one key without bound.

    Only the preserved side of an outer join can be split at run time. As an
    inner join plus the unmatched rows, the repeated side can be split too. The
    unmatched rows come from a marker and not from an anti-join, which would move
    below an aggregate on the left and make the two halves compute it twice.
    """
    marked = right.select(*keys).distinct().withColumn("_matched", F.lit(True))
    flagged = left_join(left, marked, keys)
    unmatched = flagged.filter("_matched is null").drop("_matched")
    matched = inner_join(left, right, keys)
    return matched.unionByName(unmatched, allowMissingColumns=True)
