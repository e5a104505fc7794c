"""Fill-in-the-middle: texts cut at two token boundaries and put together out of order.

A document's identity decides how many tokens its prefix and its middle have, and which
form it takes; the cuts are found by select on the set of its token boundaries
(:mod:`gridtally.llm.boundary_sets`). Only three numbers of a document come back from
Python; the output is put together, and taken apart again, by Spark expressions. There
is no exchange: every document is on its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from gridtally.llm.boundary_sets import token_boundaries

PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Settings:
    """What decides the cuts and the form of a document.

    ``percent`` of the documents are transformed, and ``spm_percent`` of these with the
    suffix first. The marks must start with a character that they hold once, so that
    no text around one can complete another.
    """

    seed: int = 1
    percent: int = 90
    spm_percent: int = 20
    prefix_mark: str = "<P>"
    suffix_mark: str = "<S>"
    middle_mark: str = "<M>"

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix_mark, self.suffix_mark, self.middle_mark

    def __post_init__(self) -> None:
        first = {mark[:1] for mark in self.marks}
        if len(set(self.marks)) < 3 or len(first) > 1 or any(m.count(m[:1]) != 1 for m in self.marks):
            raise ValueError(f"marks {self.marks} can be mistaken for each other")


_CUTS = StructType()
for _name in ("n", "first", "second"):
    _CUTS.add(_name, LongType())


@F.pandas_udf(_CUTS)
def _cuts(text: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Token count and both cut offsets for two numbers that are taken modulo the cuts."""

    def of(text: str, a: int, b: int) -> tuple[int, int, int]:
        boundaries = token_boundaries(text)
        cuts = len(boundaries)
        first, second = sorted((int(a) % cuts, int(b) % cuts))
        return cuts - 1, boundaries.select(first), boundaries.select(second)

    rows = [of(*row) for row in zip(text, a, b)]
    return pd.DataFrame(rows, columns=_CUTS.names)


def _numbers(identity: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of seed and identity."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), identity), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    settings: Settings = Settings(),
) -> DataFrame:
    """``id_column``, ``text``, ``n``, ``form``, ``first``, ``second`` and ``output``, a row a document.

    ``n`` counts the text's tokens (runs of A-Z and a-z, any other code point alone).
    ``first`` and ``second`` are the offsets, in code points, where the prefix and the
    middle end; both are NULL in plain form, in which ``output`` is the text itself.
    Empty texts, and texts that hold one of the marks, stay plain.

    A NULL text is an empty one; a NULL id counts as an empty string when the cuts are
    drawn. Repeated ids, and repeated rows, are rows like any other: the cuts of rows
    with the same id and text are the same. An empty table gives no rows. Other columns
    are left out, whatever their names.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    identity = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    a, b, c, d = _numbers(identity, settings.seed)
    rows = docs.select(
        F.col(id_column), text.alias("text"), a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d")
    )
    cut = rows.select("*", _cuts("text", "a", "b").alias("cut"))

    marked = F.lit(False)
    for mark in settings.marks:
        marked = marked | F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | marked | (F.col("c") % 100 >= settings.percent)
    form = (
        F.when(plain, PLAIN)
        .when(F.col("d") % 100 < settings.spm_percent, SPM)
        .otherwise(PSM)
    )
    formed = cut.select(
        id_column,
        "text",
        F.col("cut.n").alias("n"),
        form.alias("form"),
        F.when(~plain, F.col("cut.first")).alias("first"),
        F.when(~plain, F.col("cut.second")).alias("second"),
    )
    return formed.select("*", _joined(settings).alias("output"))


def _joined(settings: Settings) -> Column:
    whole, first, second = F.col("text"), F.col("first").cast("int"), F.col("second").cast("int")
    prefix = F.substring(whole, F.lit(1), first)
    middle = F.substring(whole, first + 1, second - first)
    suffix = F.substring(whole, second + 1, F.length(whole))
    p, s, m = (F.lit(mark) for mark in settings.marks)
    return (
        F.when(F.col("form") == PSM, F.concat(p, prefix, s, suffix, m, middle))
        .when(F.col("form") == SPM, F.concat(s, suffix, p, prefix, m, middle))
        .otherwise(whole)
    )


def restored(output: Column, form: Column, settings: Settings = Settings()) -> Column:
    """The exact text behind an output of the given form."""
    marks = "|".join(rf"\Q{mark}\E" for mark in settings.marks)
    parts = F.split(output, marks)
    return (
        F.when(form == PSM, F.concat(parts[1], parts[3], parts[2]))
        .when(form == SPM, F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )
