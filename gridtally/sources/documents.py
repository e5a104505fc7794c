"""JSON model outputs, one document per text file.

Parsing works on any frame with ``file_name`` and ``text``, so documents that
come from a table take the same path as documents that come from files.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DecimalType, StructType, VariantType

from gridtally.functions import clock
from gridtally.functions.numbers import number_from_text
from gridtally.sources.listing import list_files

# Families of model output, told apart by a mark in the path.
SAVINGS_FAMILY = "metered_savings_"
HOURLY_FAMILY = "hourly_model_full_output_"

# Values stay text while parsing: one odd value must not cost the whole document.
_SAVINGS = "metered_savings MAP<STRING, STRING>"
_SCHEMA = f"ARRAY<STRUCT<data STRUCT<{_SAVINGS}>, {_SAVINGS}>>"

LOADED, REJECTED = "loaded", "rejected"

# Why a document is rejected.
UNREAD = "not read"
BLANK = "blank"
TRUNCATED = "truncated"
MALFORMED = "malformed"
TRAILING = "trailing text"
NO_OBJECT = "no object"
WRONG_TYPE = "wrong field type"


def _path(uri: Column) -> Column:
    """The path of a URI: its escapes undone, but a literal plus sign is not one.

    Local files are written with one slash by some of Spark's interfaces, with three by others.
    """
    one_form = F.regexp_replace(uri, "^file:/+", "file:///")
    return F.url_decode(F.replace(one_form, F.lit("+"), F.lit("%2B")))


def list_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``file_path, file_name`` of all ``*.txt`` files below ``folder``, empty ones included.

    The list is a table, written at once, so that files which vanish afterwards are still
    on it. Names that start with ``.`` or ``_`` are not listed. Raises when there are none.
    """
    listed = list_files(spark, folder, ".txt")
    if listed.isEmpty():
        raise ValueError(f"no .txt files found below {folder}")
    return listed.select(F.col("path").alias("file_path"), F.col("name").alias("file_name"))


def read_text_documents(
    spark: SparkSession, folder: str, listed: DataFrame | None = None
) -> DataFrame:
    """All ``*.txt`` files below ``folder`` as ``file_path, file_name, text``.

    Raises when there are none; ``listed`` is the table of :func:`list_documents`, if it is
    at hand. Files of zero bytes, and files that vanish before they are read, give no row
    here; :func:`with_unread` adds them. A file of blanks gives one, and is rejected when
    parsed. Many small files share a task; lower ``spark.sql.files.openCostInBytes`` to
    pack more of them together.
    """
    if listed is None:
        list_documents(spark, folder)
    files = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.txt")
        .option("ignoreMissingFiles", True)
        .text(folder, wholetext=True)
    )
    path = _path(F.col("_metadata.file_path"))
    return files.select(
        path.alias("file_path"),
        F.substring_index(path, "/", -1).alias("file_name"),
        F.col("value").alias("text"),
    )


def of_family(documents: DataFrame, family: str) -> DataFrame:
    """Documents whose path, folders included, contains the family's mark."""
    return documents.filter(F.contains("file_path", F.lit(family)))


def read_savings_documents(
    spark: SparkSession, folder: str, listed: DataFrame | None = None
) -> DataFrame:
    return of_family(read_text_documents(spark, folder, listed), SAVINGS_FAMILY)


def parse_savings(documents: DataFrame, unwrap: bool = True) -> DataFrame:
    """Add ``status``, ``reason`` and the ``savings`` map (time text to value text).

    With ``unwrap``, a document's ``data`` envelope is used whenever it is there,
    even if it holds no savings. Malformed and empty documents are ``rejected``, and
    so is a document with anything behind its object: the text is parsed as the only
    element of a list, because the parser stops reading behind a whole object. So is one
    whose envelope or savings are something else than an object or ``null``. ``reason``
    tells rejected documents apart; it is NULL for the others.
    """
    parsed = F.from_json(F.concat(F.lit("["), F.col("text"), F.lit("]")), _SCHEMA)
    frame = documents.withColumn("_list", parsed)
    first = F.get("_list", F.lit(0))
    sound = F.coalesce((F.size("_list") == 1) & first.isNotNull(), F.lit(False))
    savings = first["metered_savings"]
    if unwrap:
        inner = first["data"]["metered_savings"]
        savings = F.when(first["data"].isNotNull(), inner).otherwise(savings)
    # Only a document without savings, or without an envelope, is looked at more closely.
    unclear = savings.isNull()
    if unwrap:
        unclear |= first["data"].isNull() & F.contains("text", F.lit('"data"'))
    reason = F.when(~sound, _rejection(F.col("text"))).when(
        unclear & _wrong_type(F.col("text"), unwrap), WRONG_TYPE
    )
    told = frame.select(*documents.columns, reason.alias("reason"), savings.alias("_savings"))
    good = F.col("reason").isNull()
    return told.select(
        *documents.columns,
        F.when(good, LOADED).otherwise(REJECTED).alias("status"),
        "reason",
        F.when(good, F.col("_savings")).alias("savings"),
    )


def _only_element(text: Column) -> Column:
    """The document as a VARIANT; NULL if there is none, or anything behind it."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    second = F.try_variant_get(wrapped, "$[1]", "variant")
    return F.when(second.isNull(), F.try_variant_get(wrapped, "$[0]", "variant"))


def _rejection(text: Column) -> Column:
    """Why the text holds no savings document; an expression for the few that do not."""
    # Without its strings, what is left of a cut text closes fewer brackets than it opens,
    # or has a quote left.
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', "")

    def count(marks: str) -> Column:
        return F.length(bare) - F.length(F.translate(bare, marks, ""))

    cut = (count("[{") > count("]}")) | (count('"') > 0)
    return (
        F.when(text.isNull() | (F.trim(F.translate(text, "\t\r\n", "   ")) == ""), BLANK)
        .when(_only_element(text).isNotNull(), NO_OBJECT)
        # The parser reads one value and stops.
        .when(F.try_parse_json(text).isNotNull(), TRAILING)
        .when(cut, TRUNCATED)
        .otherwise(MALFORMED)
    )


def _wrong_type(text: Column, unwrap: bool) -> Column:
    """Whether the envelope, or what should be the savings, is neither an object nor null."""

    def kind(path: str) -> Column:
        found = F.try_variant_get(F.try_parse_json(text), path, "variant")
        return F.regexp_substr(F.coalesce(F.schema_of_variant(found), F.lit("VOID")), F.lit("^[A-Z]+"))

    def wrong(path: str) -> Column:
        return ~kind(path).isin("OBJECT", "VOID")

    if not unwrap:
        return wrong("$.metered_savings")
    no_envelope = kind("$.data") == "VOID"
    inside = wrong("$.data") | wrong("$.data.metered_savings")
    return F.when(no_envelope, wrong("$.metered_savings")).otherwise(inside)


def with_unread(parsed: DataFrame, listed: DataFrame) -> DataFrame:
    """Adds the listed files that gave no row, empty or vanished, as ``rejected``."""
    unread = listed.join(parsed.select("file_path"), "file_path", "left_anti")
    rejected = unread.withColumns({"status": F.lit(REJECTED), "reason": F.lit(UNREAD)})
    return parsed.unionByName(rejected, allowMissingColumns=True)


def rejects(parsed: DataFrame) -> DataFrame:
    """Documents that could not be parsed, with their text and the reason."""
    return parsed.filter(F.col("status") == REJECTED).drop("savings")


def reject_reasons(parsed: DataFrame) -> DataFrame:
    """How many documents were rejected for which reason."""
    return rejects(parsed).groupBy("reason").agg(F.count(F.lit(1)).alias("n_documents"))


def unreadable_value(value: Column) -> Column:
    """A value that is present but no number, or none that a double holds."""
    return value.isNotNull() & number_from_text(value).isNull()


def unreadable_time(text: Column) -> Column:
    return clock.utc_from_text(text).isNull()


def load_report(parsed: DataFrame) -> DataFrame:
    """Documents per status, with their values and what could not be read of them."""
    values, times = F.map_values("savings"), F.map_keys("savings")

    def total(items: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.size(items)), F.lit(0)).alias(name)

    return parsed.groupBy("status").agg(
        F.count(F.lit(1)).alias("n_documents"),
        total(values, "n_values"),
        total(F.filter(values, unreadable_value), "n_unreadable"),
        total(F.filter(times, unreadable_time), "n_unreadable_times"),
    )


# -- documents of unknown shape --------------------------------------------------


def parse_any(documents: DataFrame) -> DataFrame:
    """Documents as ``VARIANT``; malformed text, and text behind the document, gives NULL."""
    return documents.select(
        *[c for c in documents.columns if c != "text"],
        _only_element(F.col("text")).alias("document"),
    )


def profile(parsed: DataFrame) -> DataFrame:
    """Top-level fields of variant documents: in how many they occur and as which type."""
    explode = parsed.sparkSession.tvf.variant_explode
    fields = parsed.lateralJoin(explode(F.col("document").outer()))
    return fields.groupBy(F.col("key").alias("field")).agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.schema_of_variant_agg("value").alias("type"),
    )


def document_type(parsed: DataFrame) -> StructType:
    """The type that all variant documents together have, as one row brings it back.

    Fields that documents disagree on are VARIANT. Only objects count.
    """
    text = _objects(parsed).agg(F.schema_of_variant_agg("document")).first()[0] or "VOID"
    if not text.startswith("OBJECT<"):
        return StructType()
    # Names of fields may hold anything and stand in backticks then.
    parts = text.split("`")
    parts[::2] = [part.replace("OBJECT<", "STRUCT<") for part in parts[::2]]
    spark = parsed.sparkSession
    return spark.createDataFrame([], f"document {'`'.join(parts)}").schema["document"].dataType


def _objects(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.startswith(F.schema_of_variant("document"), F.lit("OBJECT")))


def typed_rows(parsed: DataFrame, kind: StructType | None = None) -> DataFrame:
    """The tables behind variant documents: a row for each place of their lists.

    Columns are the fields of ``kind`` (found by :func:`document_type` in a pass of its own
    unless given), objects in them flattened, with their names joined by ``_``; a name that
    is taken gets a number. Lists in one document stand next to each other, ended by NULLs
    where one is shorter; single values repeat. ``row`` counts the rows of a document from 0;
    one without lists is one row. Numbers with a fraction are doubles. Lists of objects, and
    values of no common type, are JSON texts. Documents that are no objects give no rows.
    Other columns of ``parsed`` come first.
    """
    kind = document_type(parsed) if kind is None else kind
    others = [c for c in parsed.columns if c != "document"]
    objects = _objects(parsed).select(
        *others, F.try_variant_get("document", "$", _ddl(kind)).alias("_document")
    )
    taken = {*others, "row"}
    leaves = [
        (_free(name, taken), _shown_type(leaf), _shown(leaf, column))
        for name, leaf, column in _leaves(kind, F.col("_document"))
    ]
    lists = {name for name, leaf, _ in leaves if isinstance(leaf, ArrayType)}
    flat = objects.select(*others, *[column.alias(name) for name, _, column in leaves])
    lengths = [F.coalesce(F.size(_named(name)), F.lit(0)) for name in lists]
    length = F.greatest(F.lit(1), F.lit(1), *lengths)
    placed = flat.select("*", F.explode(F.sequence(F.lit(0), length - 1)).alias("row"))

    def cell(name: str) -> Column:
        return F.get(_named(name), F.col("row")).alias(name) if name in lists else _named(name)

    return placed.select(*others, "row", *[cell(name) for name, _, _ in leaves])


def _free(name: str, taken: set[str]) -> str:
    """The name, numbered if it is taken; takes it."""
    chosen, n = name, 1
    while chosen in taken:
        n += 1
        chosen = f"{name}_{n}"
    taken.add(chosen)
    return chosen


def _named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _ddl(kind: DataType) -> str:
    """The type as text, with all names quoted."""
    if isinstance(kind, StructType):
        fields = [f"`{f.name.replace('`', '``')}`: {_ddl(f.dataType)}" for f in kind.fields]
        return f"struct<{', '.join(fields)}>"
    if isinstance(kind, ArrayType):
        return f"array<{_ddl(kind.elementType)}>"
    return kind.simpleString()


def _leaves(kind: StructType, value: Column) -> Iterator[tuple[str, DataType, Column]]:
    """Name, type and column of each field that is no object, in order."""
    for field in kind.fields:
        inner = value.getField(field.name)
        if isinstance(field.dataType, StructType):
            for name, leaf, column in _leaves(field.dataType, inner):
                yield f"{field.name}_{name}", leaf, column
        else:
            yield field.name, field.dataType, inner


def _is_text(kind: DataType) -> bool:
    """Variants and lists of objects cannot be compared or grouped; their JSON can."""
    nested = kind.elementType if isinstance(kind, ArrayType) else kind
    return isinstance(nested, VariantType) or (nested is not kind and isinstance(nested, StructType))


def _shown_type(kind: DataType) -> DataType:
    return VariantType() if _is_text(kind) else kind


def _shown(kind: DataType, value: Column) -> Column:
    if _is_text(kind):
        return F.to_json(value)
    if isinstance(kind, DecimalType):
        return value.cast("double")
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, DecimalType):
        return value.cast("array<double>")
    return value
