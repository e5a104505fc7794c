"""Customer samples: by savings quartile, simple, and the check of a sample."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import ROUND_HALF_EVEN, Context, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtally.functions.exact import nan_to_null
from gridtally.operators.draws import draw
from gridtally.operators.quantiles import exact_quantiles

# Quartile probabilities, stratum labels and the sample sizes.
QUARTILE_PROBABILITIES = (0.0, 0.25, 0.5, 0.75, 1.0)
NEGATIVE = "NEG"
QUARTILES = ("Q1", "Q2", "Q3", "Q4")
NEGATIVE_SIZE = 1_000
QUARTILE_SIZE = 2_250
SIMPLE_SIZE = 14_000
SIMPLE_SEED = 12

# Digits enough for any double.
_WIDE = Context(prec=400)


def _savings() -> Column:
    """Savings; NaN is missing, and Spark would take it for the largest number."""
    return nan_to_null(F.col("metered_savings"))


@dataclass(frozen=True)
class Sample:
    """A stratified draw: ``stratum, item_id, metered_savings``, and its break points."""

    rows: DataFrame
    breaks: list[float]

    def ids(self) -> DataFrame:
        return self.rows.select("item_id")


def quartile_breaks(frame: DataFrame) -> list[float]:
    """Exact quartiles, minimum and maximum of the savings that are not negative."""
    breaks = exact_quantiles(frame.filter(_savings() >= 0), "metered_savings", QUARTILE_PROBABILITIES)
    if breaks[0] is None:
        raise ValueError("no row with savings of zero or more")
    return breaks


def quartile_table(frame: DataFrame) -> DataFrame:
    """The break points as one row."""
    names = ["p0", "p25", "p50", "p75", "p100"]
    row = [F.lit(float(b)).alias(n) for n, b in zip(names, quartile_breaks(frame))]
    return frame.sparkSession.range(1).select(*row)


def sampling_stratum(breaks: Sequence[float]) -> Column:
    """Stratum of a row when drawing: ``[break, next break)``, the last one open-ended."""
    return (
        F.when(_savings() < 0, NEGATIVE)
        .when(_savings() >= F.lit(breaks[3]), QUARTILES[3])
        .when(_savings() >= F.lit(breaks[2]), QUARTILES[2])
        .when(_savings() >= F.lit(breaks[1]), QUARTILES[1])
        .when(_savings() >= F.lit(breaks[0]), QUARTILES[0])
    )


def checking_bin(breaks: Sequence[float]) -> Column:
    """Bin of a row when checking: ``(break, next break]``, the lowest one closed.

    Not the strata of the draw: a value on a break falls in the lower bin here
    and in the upper one there.
    """
    if len(set(breaks)) < len(breaks):
        raise ValueError(f"break points are not unique: {list(breaks)}")
    return (
        F.when(_savings() < F.lit(breaks[0]), None)
        .when(_savings() <= F.lit(breaks[1]), QUARTILES[0])
        .when(_savings() <= F.lit(breaks[2]), QUARTILES[1])
        .when(_savings() <= F.lit(breaks[3]), QUARTILES[2])
        .when(_savings() <= F.lit(breaks[4]), QUARTILES[3])
    )


def stratified_sample(
    frame: DataFrame,
    n_negative: int = NEGATIVE_SIZE,
    n_per_quartile: int = QUARTILE_SIZE,
    seed: int | str = SIMPLE_SEED,
) -> Sample:
    """Fixed numbers of rows with negative savings and from each quartile of the rest.

    Raises when a stratum is too small.
    """
    breaks = quartile_breaks(frame)
    stratified = frame.withColumn("stratum", sampling_stratum(breaks))
    sizes = {NEGATIVE: n_negative, **{q: n_per_quartile for q in QUARTILES}}
    columns = ["item_id", "metered_savings"]
    return Sample(draw(stratified, columns, sizes, seed, "stratum"), breaks)


def simple_sample(
    frame: DataFrame, n: int = SIMPLE_SIZE, seed: int | str = SIMPLE_SEED
) -> DataFrame:
    """``n`` rows without replacement, or all rows if there are fewer; ids only."""
    whole = frame.select("item_id", F.lit("ALL").alias("stratum"))
    return draw(whole, ["item_id"], {"ALL": n}, seed, "stratum", strict=False).select("item_id")


def sample_check(sample: Sample) -> DataFrame:
    """Report on a sample: negatives drawn, rounded break points, rows per bin.

    Bins without rows are listed with 0.
    """
    spark = sample.rows.sparkSession
    chosen = F.when(_savings() >= 0, checking_bin(sample.breaks))
    counts = sample.rows.agg(
        F.count_if(_savings() < 0).alias("negatives"),
        *[F.count_if(chosen == q).alias(q) for q in QUARTILES],
    )
    bins = [_line("rows_in_bin", q, F.col(q)) for q in QUARTILES]
    lines = [_line("negatives", NEGATIVE, F.col("negatives")), *bins]
    counted = counts.select(F.inline(F.array(*lines)))
    breaks = [
        _line("break", f"{p:.0%}", F.lit(_two_places(b)))
        for p, b in zip(QUARTILE_PROBABILITIES, sample.breaks)
    ]
    return counted.union(spark.range(1).select(F.inline(F.array(*breaks))))


def _two_places(value: float) -> float:
    """Rounded as the decimal it prints as, ties to even; infinities stay."""
    if math.isinf(value):
        return value
    return float(Decimal(repr(float(value))).quantize(Decimal("0.01"), ROUND_HALF_EVEN, _WIDE))


def _line(metric: str, label: str, value: Column) -> Column:
    return F.struct(
        F.lit(metric).alias("metric"),
        F.lit(label).alias("label"),
        value.cast("double").alias("value"),
    )
