"""Packing documents into training sequences of several permitted lengths.

Documents longer than the longest sequence are cut into pieces at word boundaries. The
pieces are dealt out to shards of about ``SHARD_WORDS`` words, and each shard is packed
by itself, longest pieces first:

* A piece goes into the open bin that it fills best.
* If none has room, a bin is opened. Every permitted length that holds the piece is tried
  on the pieces still to come: the bin is filled with the longest that fit, again and
  again, and the length with the least cost for each word packed is opened. A bin costs
  its length after downsizing and ``BIN_COST`` more.
* In the end each bin is downsized to the shortest permitted length that holds it.

All bookkeeping is by size, a whole number up to the longest length, so a shard takes
time in proportion to its pieces and memory in proportion to its words and one document.

Cases: NULL and blank texts have no words and are in no bin. Rows with a NULL id and
repeated rows are pieces of their own. Pieces of equal size are packed in order of id,
piece and text. No rows give no bins. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtally.llm.common import WORD, word_count

LENGTHS = (256, 512, 1024, 2048, 4096)
#: What a bin costs besides its length, in words.
BIN_COST = 16
SHARD_WORDS = 1_000_000

#: Between the pieces of a sequence.
SEPARATOR = "\n\n"

BIN = (
    "shard int, bin int, length int, words int, doc_ids array<bigint>, "
    "pieces array<struct<doc_id:bigint,piece:int,words:int>>, text string"
)

EMPTY = pd.DataFrame({"doc_id": [], "piece": [], "text": [], "words": []}, dtype=object)


@dataclass
class Bin:
    capacity: int
    used: int = 0
    items: list[int] = field(default_factory=list)


class _Sizes:
    """The sizes that occur, as the bits of one whole number."""

    def __init__(self):
        self.bits, self.count = 0, {}

    def add(self, size: int) -> None:
        n = self.count.get(size, 0)
        self.count[size] = n + 1
        if not n:
            self.bits |= 1 << size

    def remove(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            self.bits ^= 1 << size

    def largest_up_to(self, size: int) -> int:
        """0 if there is none; no size is 0."""
        return max(0, (self.bits & ((2 << size) - 1)).bit_length() - 1)

    def smallest_from(self, size: int) -> int | None:
        high = self.bits >> size
        return size + (high & -high).bit_length() - 1 if high else None


def _fit(words: int, lengths: tuple[int, ...]) -> int:
    return next(length for length in lengths if length >= words)


def _cheapest(size: int, waiting: _Sizes, lengths: tuple[int, ...], bin_cost: int) -> int:
    """The length to open for a piece, judged by how the pieces to come would fill it."""
    best = None
    for length in lengths:
        if length < size:
            continue
        words, taken = size, {}
        limit = length - words
        while (more := waiting.largest_up_to(limit)) > 0:
            free = waiting.count[more] - taken.get(more, 0)
            n = min(free, (length - words) // more)
            words += n * more
            taken[more] = taken.get(more, 0) + n
            # Used up, or too long for what is left.
            limit = min(more - 1, length - words)
        cost = (_fit(words, lengths) + bin_cost) / words
        if best is None or cost < best[0]:
            best = (cost, length)
    return best[1]


def pack(sizes: list[int], lengths: tuple[int, ...], bin_cost: int = BIN_COST) -> list[Bin]:
    """Bins for pieces of these sizes (at least 1, at most the longest length).

    ``items`` of a bin are positions in ``sizes``; ``capacity`` is the downsized length.
    """
    waiting, rooms = _Sizes(), _Sizes()
    for size in sizes:
        waiting.add(size)
    open_bins: dict[int, list[Bin]] = {}
    bins: list[Bin] = []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[item]
        waiting.remove(size)
        room = rooms.smallest_from(size)
        if room is None:
            target = Bin(_cheapest(size, waiting, lengths, bin_cost))
            bins.append(target)
        else:
            target = open_bins[room].pop()
            rooms.remove(room)
        target.items.append(item)
        target.used += size
        left = target.capacity - target.used
        if left:
            rooms.add(left)
            open_bins.setdefault(left, []).append(target)
    for target in bins:
        target.capacity = _fit(target.used, lengths)
    return bins


def _pieces(text: Column, longest: int) -> Column:
    """A text cut behind every ``longest`` words: array<string>; blank texts have no piece."""
    blank = r"[\x20\x09-\x0D]"
    return F.regexp_extract_all(
        text, F.lit(rf"(?:{blank}*+{WORD}+){{1,{longest}}}+"), F.lit(0)
    )


def packed(
    docs: DataFrame,
    lengths: tuple[int, ...] = LENGTHS,
    bin_cost: int = BIN_COST,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """One row per sequence, as in ``BIN``; lengths are counted in words.

    ``pieces`` and ``doc_ids`` are in the order in which their texts stand in ``text``.
    """
    lengths = tuple(sorted(lengths))
    pieces = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.posexplode(_pieces(F.col("text"), lengths[-1])).alias("piece", "text"),
    ).select("doc_id", "piece", "text", word_count(F.col("text")).cast("int").alias("words"))
    total = pieces.agg(F.sum("words")).first()[0] or 0
    n_shards = max(1, -(-total // shard_words))

    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([EMPTY, *batches]).sort_values(["doc_id", "piece", "text"])
        ids = [None if pd.isna(i) else int(i) for i in rows["doc_id"]]
        places, words, texts = rows["piece"].tolist(), rows["words"].tolist(), rows["text"].tolist()
        shard = TaskContext.get().partitionId()
        out = [
            (
                shard,
                number,
                target.capacity,
                target.used,
                [ids[i] for i in target.items],
                [(ids[i], places[i], words[i]) for i in target.items],
                SEPARATOR.join(texts[i].strip(" \t\n\x0b\x0c\r") for i in target.items),
            )
            for number, target in enumerate(pack(words, lengths, bin_cost))
        ]
        columns = ["shard", "bin", "length", "words", "doc_ids", "pieces", "text"]
        yield pd.DataFrame(out, columns=columns)

    # Dealt out in turn, so that even equal rows spread; Spark sorts before it deals, so
    # that a task that runs again deals alike.
    return pieces.repartition(n_shards).mapInPandas(bins, BIN)
