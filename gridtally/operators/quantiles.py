"""Exact quantiles of a column too large for one task.

Spark's ``percentile`` keeps every distinct value in one final aggregate. Here a
quantile sketch proposes a narrow range around each wanted rank, and one counting
pass proves where the rank lies relative to that range; the next round looks
inside. The sketch steers the search; every answer rests on exact counts, so a
poor sketch costs another pass and never a wrong value. The ends of a proposed
range are values of the column that the next range leaves out, so every round
leaves fewer rows and the search ends. Each pass is a map-side aggregate that
sends one row per task. A value shared by very many rows sits on the edge of its
range and is resolved by its count alone. All sizes take this one path.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtally.functions.exact import nan_to_null

SKETCH_ACCURACY = 10_000


@dataclass
class _Range:
    """Values in ``[low, high]`` known to hold the row with this 0-based rank."""

    rank: int
    low: float
    high: float
    up_to_low: int  # rows <= low
    below_high: int  # rows < high

    @property
    def inner_rows(self) -> int:
        return max(self.below_high - self.up_to_low, 0)

    @property
    def answer(self) -> float | None:
        if self.rank < self.up_to_low:
            return self.low
        if self.rank >= self.below_high:
            return self.high
        return None

    def inner(self, value: Column) -> Column:
        return (value > F.lit(self.low)) & (value < F.lit(self.high))


def exact_quantiles(
    df: DataFrame,
    column: str,
    probabilities: Sequence[float],
    accuracy: int = SKETCH_ACCURACY,
) -> list[float | None]:
    """Quantiles with linear interpolation between neighbouring rows (type 7).

    NULLs and NaNs are ignored; an empty column gives ``None`` for every probability.
    Runs a few jobs that read one column and bring back one row each.
    """
    given = nan_to_null(F.col(column).cast("double"))
    values = df.select(given.alias("x")).filter("x is not null")
    x = F.col("x")
    total, low, high, minus_inf, plus_inf = values.agg(
        F.count(x),
        F.min(x),
        F.max(x),
        F.count_if(x == F.lit(-math.inf)),
        F.count_if(x == F.lit(math.inf)),
    ).first()
    if total == 0:
        return [None for _ in probabilities]

    positions = [(total - 1) * p for p in probabilities]
    ranks = {r for h in positions for r in (math.floor(h), math.ceil(h))}
    found: dict[int, float] = {0: low, total - 1: high}
    open_ranges = [
        _Range(rank, -math.inf, math.inf, minus_inf, total - plus_inf)
        for rank in sorted(ranks - found.keys())
    ]

    while True:
        found |= {r.rank: r.answer for r in open_ranges if r.answer is not None}
        open_ranges = [r for r in open_ranges if r.answer is None]
        if not open_ranges:
            break
        open_ranges = _narrow(values, x, open_ranges, accuracy)
    return [_interpolate(found, h) for h in positions]


def _narrow(values: DataFrame, x: Column, ranges: list[_Range], accuracy: int) -> list[_Range]:
    """Shrink each range around its rank: one sketch pass, one counting pass."""
    slack = 2.0 / accuracy
    sketches = []
    for r in ranges:
        place = (r.rank - r.up_to_low + 0.5) / r.inner_rows
        around = [max(place - slack, 0.0), min(place + slack, 1.0)]
        inner = F.when(r.inner(x), x)
        sketches.append(F.percentile_approx(inner, around, accuracy))
    proposals = values.agg(*[s.alias(f"s{i}") for i, s in enumerate(sketches)]).first()

    counts = []
    for i, (a, b) in enumerate(proposals):
        counts += [
            F.count_if(x <= F.lit(a)).alias(f"le_a{i}"),
            F.count_if(x < F.lit(a)).alias(f"lt_a{i}"),
            F.count_if(x <= F.lit(b)).alias(f"le_b{i}"),
            F.count_if(x < F.lit(b)).alias(f"lt_b{i}"),
        ]
    seen = values.agg(*counts).first()

    narrowed = []
    for i, (r, (a, b)) in enumerate(zip(ranges, proposals)):
        if r.rank < seen[f"lt_a{i}"]:  # sketch overshot: rank lies left of a
            narrowed.append(_Range(r.rank, r.low, a, r.up_to_low, seen[f"lt_a{i}"]))
        elif r.rank >= seen[f"le_b{i}"]:  # sketch undershot: rank lies right of b
            narrowed.append(_Range(r.rank, b, r.high, seen[f"le_b{i}"], r.below_high))
        else:
            narrowed.append(_Range(r.rank, a, b, seen[f"le_a{i}"], seen[f"lt_b{i}"]))
    return narrowed


def _interpolate(found: dict[int, float], position: float) -> float:
    below, above = found[math.floor(position)], found[math.ceil(position)]
    share = position - math.floor(position)
    return below if share == 0 else (1 - share) * below + share * above
