"""CSV tables as analysts hand them over: typed by name, tolerant about blanks.

Columns are read as text in one pass (no inference pass over the data) and then
cast. A cell that does not fit its type becomes NULL, and a :class:`CellReport` counts it
in whatever pass reads the file.
"""

from __future__ import annotations

from collections.abc import Mapping

from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gridtally.functions import clock
from gridtally.functions.numbers import integer_from_text, number_from_text

# Spellings of a missing cell and of the two truth values.
MISSING = "NA"
TRUE_WORDS = ("T", "TRUE", "true", "True")
FALSE_WORDS = ("F", "FALSE", "false", "False")


@dataclass
class CellReport:
    """Cells read and cells lost, for each column of the tables it watches.

    The counts ride along in the first pass over each table, so they cost no scan. A pass
    that Spark skips, because nothing it reads can reach a result, counts nothing; such a
    table is counted when the report is made. An executor lost in mid-pass may have its
    cells counted twice.
    """

    _watched: list[tuple] = field(default_factory=list)

    def watch(self, table: str, typed: DataFrame, present: Mapping[str, str]) -> DataFrame:
        """``typed``, observed. ``present`` names the flag of each column that had a cell."""
        counts = {}
        for i, (column, flag) in enumerate(present.items()):
            held = F.col(flag)
            counts[f"cells_{i}"] = F.count_if(held)
            counts[f"lost_{i}"] = F.count_if(held & _column(column).isNull())
        observation = Observation()
        self._watched.append((table, list(present), counts, typed, observation))
        return typed.observe(observation, *[c.alias(name) for name, c in counts.items()])

    def table(self, spark: SparkSession) -> DataFrame:
        """``table, column, n_cells, n_lost``, after the passes."""
        rows = []
        for name, columns, counts, typed, observation in self._watched:
            try:
                seen = observation.get
            except Py4JJavaError:  # no metrics: the pass was skipped
                seen = typed.agg(*[c.alias(n) for n, c in counts.items()]).first().asDict()
            rows += [
                (name, column, seen[f"cells_{i}"], seen[f"lost_{i}"])
                for i, column in enumerate(columns)
            ]
        return spark.createDataFrame(
            rows, "`table` string, `column` string, n_cells long, n_lost long"
        )


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    columns: Mapping[str, str],
    blank_is_null: bool = True,
    multiline: bool = False,
    report: CellReport | None = None,
    table: str | None = None,
) -> DataFrame:
    """Read the named columns of CSV files that share one header.

    ``columns`` maps header names, verbatim, to ``string``, ``double``, ``int``,
    ``boolean`` or ``utc`` (a time, UTC unless it names a zone). Cells are trimmed;
    ``NA`` and blanks are missing. With ``blank_is_null=False`` text keeps blanks
    and spaces, and only ``NA`` is missing in it. ``multiline`` allows line breaks
    inside quotes, at the price of one task per file. ``report`` counts the cells, and
    those lost, under the name ``table`` (the path if there is none).
    """
    text = spark.read.csv(
        path,
        header=True,
        inferSchema=False,
        quote='"',
        escape='"',
        multiLine=multiline,
        enforceSchema=False,
        mode="PERMISSIVE",
    )
    absent = [name for name in columns if name not in text.columns]
    if absent:
        raise ValueError(f"columns {absent} not in the header {text.columns}")
    typed = [_typed(_column(name), kind, blank_is_null).alias(name) for name, kind in columns.items()]
    if report is None:
        return text.select(*typed)
    flags = {name: f"_present_{i}" for i, name in enumerate(columns)}
    present = [_cell(_column(name)).isNotNull().alias(flag) for name, flag in flags.items()]
    watched = report.watch(table or str(path), text.select(*typed, *present), flags)
    return watched.drop(*flags.values())


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _cell(cell: Column) -> Column:
    """The trimmed cell; NULL if it is missing."""
    text = F.trim(cell)
    return F.when((text != "") & (text != MISSING), text)


def _typed(cell: Column, kind: str, blank_is_null: bool) -> Column:
    if kind == "string" and not blank_is_null:
        kept = F.coalesce(cell, F.lit(""))
        return F.when(kept != MISSING, kept)
    text = _cell(cell)
    match kind:
        case "string":
            return text
        case "double":
            return number_from_text(text)
        case "int":
            return integer_from_text(text)
        case "boolean":
            return F.when(text.isin(*TRUE_WORDS), True).when(text.isin(*FALSE_WORDS), False)
        case "utc":
            return clock.utc_from_text(text)
    raise ValueError(f"unknown column type {kind!r}")
