"""Mixing sources to target weights by weighted fair queueing.

Every source shuffles its documents and plays them, round after round. A copy of a
document gets a virtual finish time: the words its source has played up to its end,
divided by the source's target. Copies are served in the order of their finish times
until the total budget is used up, so that each source's share follows its target.

Nothing is ordered in one task. The running words of a source are a sum over shuffle
buckets plus a window inside one bucket; the finish time that uses up the budget comes
from a histogram of finish times and the few copies inside one of its bins. Identical rows
are counted, which combines them before the shuffle, and then numbered and spread again.

Cases: a NULL source is a source of its own, last in order. A NULL text has size 0;
documents of size 0 are never taken more than 0 words. Repeated rows are documents of
their own, with shuffle keys of their own, and so are rows without an id. Copies that
finish at the very same time are served in the order of their shuffle keys. No rows
give no rows. Columns of the input come back inside ``doc``, so names cannot clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtally.llm.common import checkpointed

#: Bits of the shuffle key that name a bucket, and of its whole length.
BUCKET_BITS, KEY_BITS = 14, 52
#: Bins of virtual time between 0 and 1; later finishes share the last bins.
TIME_BINS = 1 << 16


#: Identical rows that are numbered in place; further ones are spread first.
COPIES_PER_BLOCK = 1_000

_OWN = ("doc_id", "source", "size")


def _numbered(rows: DataFrame) -> DataFrame:
    """``doc``, a struct of the row, and ``copy``, its number among identical rows."""
    whole = rows.select(F.struct("*").alias("doc"))
    counted = whole.groupBy("doc").agg(F.count(F.lit(1)).alias("copies"))
    step = F.lit(COPIES_PER_BLOCK).cast("long")
    starts = F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, step)
    further = counted.select("*", F.explode(F.slice(starts, 2, F.size(starts))).alias("start"))
    # Each block by itself: a row that is there very often is dealt out to all tasks.
    further = further.repartition("doc", "start")
    blocks = counted.withColumn("start", F.lit(0).cast("long")).unionByName(further)
    last = F.least(F.col("start") + step, F.col("copies")) - 1
    return blocks.select("doc", F.explode(F.sequence("start", last)).alias("copy"))


def shuffle_key(doc: Column, columns: list[str], copy: Column, seed: int) -> Column:
    """A pseudo-random long of 52 bits for each row and copy of it."""

    def shown(name: str) -> Column:
        return F.coalesce(doc[name].cast("string"), F.lit(""))

    parts = [F.lit(str(seed)), *map(shown, _OWN), copy.cast("string")]
    more = [doc[name] for name in columns if name not in _OWN]
    if more:
        parts.append(F.xxhash64(*more).cast("string"))
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Adds ``target`` to one row per source (``source``, ``source_size``).

    ``share`` of all words is dealt out by weight (repeating over the sources in code
    point order, NULL last); no source gets more than ``most`` times its words, and what
    is above is dealt to the others until none is above. In order of size over weight the
    sources at their limit come first, so running sums find them in one step.
    """
    everything = Window.partitionBy()
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy("ratio", "position").rowsBetween(Window.unboundedPreceding, -1)
    position = F.row_number().over(in_order)
    weight = F.element_at(F.array(*map(F.lit, weights)), (position - 1) % len(weights) + 1)
    limit = F.col("source_size") * F.lit(float(most))
    level = (F.col("budget") - F.col("limits_before")) / (F.col("weights") - F.col("weights_before"))
    return (
        sizes.withColumn("position", position)
        .withColumn("weight", weight.cast("double"))
        .withColumn("limit", limit)
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("limits_before", F.coalesce(F.sum("limit").over(by_limit), F.lit(0.0)))
        .withColumn("weights_before", F.coalesce(F.sum("weight").over(by_limit), F.lit(0.0)))
        .withColumn("level", F.when(F.col("ratio") > level, level))
        # The first source under its limit sets the level for all behind it.
        .withColumn("level", F.max("level").over(everything))
        .withColumn("target", F.least("limit", F.coalesce(F.col("level") * F.col("weight"), "limit")))
        .select("source", "source_size", "target")
    )


def _timed(
    rows: DataFrame, weights: tuple[int, ...], share: float, most: float, seed: int
) -> DataFrame:
    """Each document with its source's size and target and the words played up to its end."""
    doc = F.col("doc")
    keyed = _numbered(rows).select(
        "doc",
        F.coalesce(doc["size"].cast("long"), F.lit(0)).alias("size"),
        doc["source"].cast("string").alias("source"),
        shuffle_key(doc, rows.columns, F.col("copy"), seed).alias("key"),
    ).withColumns(
        {
            # Never NULL, so that it serves as a plain join key.
            "source_key": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")),
            "bucket": F.shiftright("key", KEY_BITS - BUCKET_BITS),
        }
    )
    before = Window.partitionBy("source_key").orderBy("bucket")
    buckets = keyed.groupBy("source_key", "source", "bucket").agg(F.sum("size").alias("words"))
    by_source = buckets.groupBy("source_key", "source").agg(F.sum("words").alias("source_size"))
    goals = targets(by_source, weights, share, most).select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("source_key"),
        "source_size",
        "target",
    )
    offsets = (
        buckets.drop("source")
        .withColumn("played_before", F.sum("words").over(before) - F.col("words"))
        .drop("words")
        .join(goals, "source_key")
    )
    inside = (
        Window.partitionBy("source_key", "bucket")
        .orderBy("key", "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return keyed.join(offsets, ["source_key", "bucket"]).withColumn(
        "played", F.col("played_before") + F.sum("size").over(inside)
    )


def _finishes(most: float) -> Column:
    """The virtual finish time of each copy, round by round."""
    return F.array(
        *[
            F.try_divide(F.col("played") + F.col("source_size") * n, F.col("target"))
            for n in range(math.ceil(most))
        ]
    )


@dataclass(frozen=True)
class _Last:
    """The last copy served, in the order of finish times and then of shuffle keys."""

    finish: float
    key: int

    def served(self, finish: Column, key: Column) -> Column:
        end = F.lit(self.finish)
        return (finish < end) | ((finish == end) & (key <= F.lit(self.key)))


_ALL, _NONE = _Last(math.inf, 0), _Last(-1.0, 0)


def _running(groups: DataFrame, order: str) -> DataFrame:
    """Adds ``served``: the words up to each group, itself included."""
    up_to = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return groups.withColumn("served", F.sum("words").over(up_to))


def _crossing(copies: DataFrame, order: Column, room: float):
    """The first value of ``order`` whose words do not fit the room, and the room before it."""
    sums = copies.groupBy(order.alias("at")).agg(F.sum("size").alias("words"))
    row = _running(sums, "at").where(F.col("served") > room).orderBy("at").first()
    return None if row is None else (row["at"], room - (row["served"] - row["words"]))


def _last_copy(timed: DataFrame, share: float, most: float) -> _Last:
    """The last copy up to which all fit the budget.

    Works on a table of three numbers a copy; single rows come to the driver. The order of
    copies is looked at more and more closely: bins of finish times, the finish times in one
    of them, bins of the keys that finish at that time, the keys in one of these.
    """
    copies = checkpointed(
        timed.where("target > 0 and size > 0").select(
            "size", "key", F.posexplode(_finishes(most)).alias("round", "finish")
        )
    )
    total = copies.where("round = 0").agg(F.sum("size")).first()[0]
    if total is None:
        return _NONE
    bin_of = F.least(F.floor(F.col("finish") * TIME_BINS), F.lit(2 * TIME_BINS))
    crossing = _crossing(copies, bin_of, min(share, most) * total)
    if crossing is None:
        return _ALL
    copies, room = copies.where(bin_of == crossing[0]), crossing[1]
    finish, room = _crossing(copies, F.col("finish"), room)
    copies = copies.where(F.col("finish") == F.lit(finish))
    # Many small sources may finish at the very same time.
    bucket = F.shiftright("key", KEY_BITS - BUCKET_BITS)
    at, room = _crossing(copies, bucket, room)
    key, _ = _crossing(copies.where(bucket == at), F.col("key"), room)
    return _Last(finish, key - 1)


def mix(
    rows: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """Decides how often each document is taken.

    ``rows`` has ``doc_id``, ``source`` and ``size`` (words) and any other columns.
    Returns one row per input row: ``doc`` (the input row), ``size``, ``source_size``,
    ``target`` (words wanted of its source), ``finishes`` (the virtual finish time of
    each copy that is taken, earliest first) and ``taken`` (words, copies counted).
    """
    timed = _timed(rows, weights, share, most, seed)
    last = _last_copy(timed, share, most)
    served = F.filter(_finishes(most), lambda finish: last.served(finish, F.col("key")))
    none = F.array().cast("array<double>")
    playable = (F.col("target") > 0) & (F.col("size") > 0)
    return (
        timed.withColumn("finishes", F.when(playable, served).otherwise(none))
        .withColumn("taken", F.size("finishes") * F.col("size"))
        .select("doc", "size", "source_size", "target", "finishes", "taken")
    )


def mixed(rows: DataFrame, in_order: bool = True, **parameters) -> DataFrame:
    """The documents of the mix themselves, each as often as it is taken.

    They come in serving order, sorted by ranges of finish times; without ``in_order`` they
    are left where they are, for a reader that deals them out anew.
    """
    played = mix(rows, **parameters).select("doc", F.explode("finishes").alias("finish"))
    return (played.orderBy("finish") if in_order else played).select("doc.*")
