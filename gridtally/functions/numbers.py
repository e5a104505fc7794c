"""Numbers written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Plain or scientific notation. Spark's own cast takes type suffixes, "NaN" and
# "Infinity" as well.
_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def number_from_text(text: Column) -> Column:
    """The double a text stands for; NULL for anything that is no number, or none a double holds."""
    plain = F.trim(text)
    value = F.when(plain.rlike(_NUMBER), plain.try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def integer_from_text(text: Column) -> Column:
    """The int a text stands for; NULL for fractions too."""
    value = number_from_text(text)
    return F.when(value == F.floor(value), value.try_cast("int"))
