"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtally.operators.checkpoints import checkpointed, shared_folder

__all__ = [
    "WORD", "checkpointed", "cut", "let", "lower_ascii", "running", "shared_folder", "start_offsets",
    "table", "text_blocks", "word_count",
]

#: A word is a run of anything but blanks and the controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Offsets are found in blocks of so many pieces, so that appending stays linear.
_BLOCK = 256


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def word_count(text: Column) -> Column:
    """The number of words in a text as a long; 0 for NULL.

    Each word with the blanks behind it becomes one character; blanks in front of the
    first word are one more character, which is taken off.
    """
    blank = r"[\x20\x09-\x0D]"
    marks = F.length(F.regexp_replace(text, rf"{WORD}+{blank}*+|{blank}++", "x"))
    leading = text.rlike(rf"^{blank}").cast("int")
    return F.coalesce(marks - leading, F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    """The text with A-Z, and nothing else, in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def running(values: Column, start: Column, kind: str, combine: Callable[[Column, Column], Column]) -> Column:
    """``start`` and what ``combine`` makes of it and each value in turn: one element more.

    ``kind`` is the type of an element. Results are made in blocks and then joined, so that
    appending stays linear; ``combine`` must not care how values are grouped.
    """

    def within(block: Column) -> Column:
        return F.aggregate(
            block, F.array(start), lambda out, x: F.concat(out, F.array(combine(F.element_at(out, -1), x)))
        )

    def of_blocks(blocks: Column) -> Column:
        bases = within(F.transform(blocks, lambda out: F.element_at(out, -1)))
        joined = F.zip_with(
            blocks,
            F.slice(bases, 1, F.size(bases) - 1),
            lambda out, base: F.transform(F.slice(out, 2, F.size(out) - 1), lambda x: combine(base, x)),
        )
        return F.concat(F.array(start), F.flatten(joined))

    def of(all_values: Column) -> Column:
        n_blocks = F.ceil(F.size(all_values) / F.lit(_BLOCK)).cast("int")
        blocks = F.transform(
            F.sequence(F.lit(0), n_blocks - 1),
            lambda b: within(F.slice(all_values, b * _BLOCK + 1, _BLOCK)),
        )
        return F.when(F.size(all_values) == 0, F.array(start)).otherwise(let(blocks, of_blocks))

    return let(values, lambda v: of(v).cast(f"array<{kind}>"))


def start_offsets(lengths: Column) -> Column:
    """Where each piece starts if pieces of these lengths (array<int>) follow each other."""
    sums = running(lengths, F.lit(0), "int", lambda a, b: a + b)
    return let(sums, lambda s: F.slice(s, 1, F.size(s) - 1))


#: Code points of a block of text.
_TEXT_BLOCK = 1024


def text_blocks(text: Column) -> Column:
    """The text in blocks, for :func:`cut`; made in one pass over it."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_TEXT_BLOCK}}}"), F.lit(0))


def cut(blocks: Column, start: Column, end: Column) -> Column:
    """Code points from ``start`` to ``end`` (exclusive) of the text in these blocks.

    A cut costs as much as it is long, and a block or two, wherever in the text it lies.
    """
    first = F.floor(start / F.lit(_TEXT_BLOCK)).cast("int")
    last = F.floor((end - 1) / F.lit(_TEXT_BLOCK)).cast("int")
    # Looking up a block is cheap; a slice looks at all of them.
    whole = (
        F.when(last == first, F.get(blocks, first))
        .when(last == first + 1, F.concat(F.get(blocks, first), F.get(blocks, last)))
        .otherwise(F.array_join(F.slice(blocks, first + 1, F.greatest(last - first + 1, F.lit(1))), ""))
    )
    part = F.substring(whole, (start - first * _TEXT_BLOCK + 1).cast("int"), (end - start).cast("int"))
    return F.when(end > start, part).otherwise(F.lit(""))
