"""Exact-size random draws that do not depend on how the data is laid out.

Every row gets an MD5 key from a seed and its content, and the rows with the
smallest keys of a stratum are its sample. Identical rows are numbered, so each
copy has a key of its own and copies are drawn one by one like any other row.

The keyed rows are written once, after the only shuffle of the frame. A first
pass over them counts rows by the leading digits of their keys. That yields the
stratum sizes and the range of keys in which the last row of the sample lies. Further
passes cut that range into 4,096 until it holds few enough to be ranked. All rows below it
belong to the sample, whatever their order; only the rows inside it are ranked. So no
task sees more than that, however large the sample is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtally.operators.checkpoints import checkpointed

# Numbers as texts of keys: the text of a double differs between engines.
KEY_DECIMAL = "decimal(31,9)"

# Rows of a stratum that one task may rank.
RANKED_ROWS = 100_000
# Hexadecimal digits by which a range is cut.
_DIGITS = 3

# Identical rows expanded where they were counted; further ones are spread out.
COPIES_PER_BLOCK = 1_000


class SampleTooLarge(ValueError):
    """A strict draw asked for more rows than a stratum has."""


def draw(
    frame: DataFrame,
    columns: Sequence[str],
    sizes: Mapping[str, int],
    seed: int | str,
    stratum: str,
    strict: bool = True,
    copies_per_block: int = COPIES_PER_BLOCK,
    ranked_rows: int = RANKED_ROWS,
) -> DataFrame:
    """Draw ``sizes[s]`` rows without replacement from each stratum ``s``.

    Returns ``stratum`` and ``columns`` (which may hold any type that casts to
    text). ``strict`` raises when a stratum is smaller than its sample; otherwise
    all of it is returned. Strata absent from ``sizes`` give no rows.
    """
    wanted = frame.select(stratum, *columns).filter(F.col(stratum).isin(*sizes))
    keyed = checkpointed(_with_keys(wanted, columns, seed, stratum, copies_per_block))
    cuts = _cuts(keyed, stratum, sizes, strict, ranked_rows)
    if not cuts:
        return keyed.select(stratum, *columns).filter(F.lit(False))

    def of(values: Mapping[str, object]) -> Column:
        return F.create_map(*[F.lit(v) for pair in values.items() for v in pair])[F.col(stratum)]

    prefix = of({name: cut.prefix for name, cut in cuts.items()})
    below = keyed.filter(F.col("_key") < prefix)
    inside = keyed.filter(F.startswith("_key", prefix))
    order = Window.partitionBy(stratum).orderBy("_key", *columns)
    ranked = inside.withColumn("_rank", F.row_number().over(order))
    edge = ranked.filter(F.col("_rank") <= of({name: cut.wanted for name, cut in cuts.items()}))
    return below.select(stratum, *columns).unionByName(edge.select(stratum, *columns))


def row_key(seed: int | str, columns: Mapping[str, str], copy: Column) -> Column:
    """MD5 over seed, content and copy number. ``columns`` maps names to types.

    Floating-point content is rendered with fixed decimals: the text of a double
    differs between engines, the text of a decimal does not.
    """
    parts = [F.lit(str(seed))]
    for name, kind in columns.items():
        value = F.col(name)
        if kind in ("double", "float"):
            value = value.try_cast(KEY_DECIMAL)
        parts.append(F.coalesce(value.cast("string"), F.lit("NA")))
    return F.md5(F.concat_ws(":", *parts, copy.cast("string")))


def _with_keys(
    frame: DataFrame, columns: Sequence[str], seed: int | str, stratum: str, block: int
) -> DataFrame:
    """One row per row of ``frame``, with its key.

    Copies are first counted (combined map-side, so a row repeated very often is
    one row per task) and then numbered, in blocks. The first block of a row is
    expanded in place, the further ones after a shuffle of the blocks, so no task
    expands a whole run.
    """
    counted = frame.groupBy(stratum, *columns).agg(F.count(F.lit(1)).alias("_copies"))
    starts = F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(block).cast("long"))
    further = counted.select(
        "*", F.explode(F.slice(starts, 2, F.size(starts))).alias("_start")
    ).repartition(stratum, *columns, "_start")
    blocks = counted.withColumn("_start", F.lit(0).cast("long")).unionByName(further)
    last = F.least(F.col("_start") + block, F.col("_copies")) - 1
    copies = blocks.select(
        stratum, *columns, F.explode(F.sequence("_start", last)).alias("_copy")
    )
    kinds = {name: kind for name, kind in frame.dtypes if name in columns}
    ordered = {name: kinds[name] for name in columns}
    key = row_key(seed, ordered, F.col("_copy")).alias("_key")
    return copies.select(stratum, *columns, key)


@dataclass
class _Cut:
    """Where a sample ends: with so many of the rows whose keys start with a prefix."""

    prefix: str
    rows: int
    wanted: int


def _cuts(
    keyed: DataFrame, stratum: str, sizes: Mapping[str, int], strict: bool, ranked_rows: int
) -> dict[str, _Cut]:
    """The cut of each stratum; its prefix is the end of all keys if all rows belong to it.

    The first pass counts keys by "leading zeros plus one digit", at most 480 rows per
    stratum; each further one cuts the range left of a stratum into 4,096 at most.
    """
    zeros = F.length("_key") - F.length(F.ltrim(F.col("_key"), F.lit("0")))
    counts = _counted(keyed, stratum, F.left(F.col("_key"), zeros + 1))
    held = {name: sum(counts.get(name, {}).values()) for name in sizes}
    short = {name: held[name] for name, size in sizes.items() if held[name] < size}
    if strict and short:
        raise SampleTooLarge(f"strata smaller than the requested sample: {short} of {dict(sizes)}")

    # "g" sorts after every hexadecimal digit.
    cuts = {name: _Cut("g", 0, 0) for name in short if held[name]}
    wanted = {name: _Cut("", held[name], size) for name, size in sizes.items() if size and name not in short}
    while wanted:
        for name, cut in wanted.items():
            cuts[name] = _crossing(counts[name], cut.wanted)
        # A whole key is shared by no more rows than its MD5 has collisions.
        wanted = {
            name: cuts[name] for name in wanted
            if cuts[name].rows > ranked_rows and len(cuts[name].prefix) < 32
        }
        if wanted:
            ranges = [(F.col(stratum) == n) & F.startswith("_key", F.lit(c.prefix)) for n, c in wanted.items()]
            longer = F.coalesce(
                *[F.when(r, F.left("_key", F.lit(len(c.prefix) + _DIGITS))) for r, c in zip(ranges, wanted.values())]
            )
            counts = _counted(keyed.filter(reduce(or_, ranges)), stratum, longer)
    return cuts


def _counted(keyed: DataFrame, stratum: str, prefix: Column) -> dict[str, dict[str, int]]:
    """Rows of each stratum by prefix."""
    counts: dict[str, dict[str, int]] = {}
    grouped = keyed.groupBy(F.col(stratum).alias("name"), prefix.alias("prefix")).count()
    for row in grouped.collect():
        counts.setdefault(row["name"], {})[row["prefix"]] = row["count"]
    return counts


def _crossing(counts: Mapping[str, int], wanted: int) -> _Cut:
    """The prefix among which the last wanted row is, and how many of its rows are wanted."""
    for prefix in sorted(counts):
        if wanted <= counts[prefix]:
            break
        wanted -= counts[prefix]
    return _Cut(prefix, counts[prefix], wanted)
