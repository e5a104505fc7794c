"""Missing-value rules for predicates, counts and sorts.

Two families of sums exist side by side in the analyses and differ only in what
a NULL does: *strict* ones are NULL as soon as one input is NULL, the others
skip NULLs and are 0 for an empty group. Spark's own ``sum`` is neither. Both are
made from exact totals (:mod:`gridtally.operators.exact_sums`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distinct_with_null(*columns: Column) -> Column:
    """Distinct count in which NULL is a value like any other.

    The struct itself is never NULL, so rows with NULL fields are counted.
    """
    return F.count_distinct(F.struct(*columns))


def sign_label(value: Column) -> Column:
    """Activity label; a NULL value keeps a NULL label, so there is no ``otherwise``."""
    return F.when(value > 0, "Active").when(value <= 0, "Inactive")


def nulls_last(*names: str) -> list[Column]:
    """Ascending sort keys with NULL at the end."""
    return [F.asc_nulls_last(name) for name in names]
