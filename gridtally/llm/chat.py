"""Chat formatting with Spark expressions only.

The rows of a conversation are collected as structs and sorted by turn; neighbouring
turns of one role become one block; blocks are joined to the text

    <|im_start|>role
    text<|im_end|>
    <|im_start|>...

Texts merged into one block are kept apart by ``<|im_part|>``, so that the turns can be
read back. A control string inside a text cannot be taken for a marker: every ``<``,
backslashes, ``|`` gets one more backslash, and reading back takes one away. Ordinary
texts stay as they are. The loss mask is a list of spans of code points that cover the
texts of the trained roles and nothing else.

A conversation becomes one text, so its rows must fit one row of Spark (2 GB).

Cases: a NULL text or role is empty; each row without a conversation id is a conversation
by itself; a NULL turn comes first; rows of the same turn are ordered by role and text;
repeated rows are turns of their own. Backslashes and line breaks in roles are escaped
too. Only the four named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtally.llm.common import let, start_offsets

# The markers of the template.
START, PART, END = "<|im_start|>", "<|im_part|>", "<|im_end|>"

_TURN = "struct<turn:bigint,role:string,text:string>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*+)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*+)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    backslashes = F.replace(role, F.lit("\\"), F.lit("\\\\"))
    return escape(F.replace(backslashes, F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    # Odd and even backslashes are told apart by cutting at the escaped ones first.
    pieces = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(
        F.transform(pieces, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\"
    )


def _blocks(turns: Column) -> Column:
    """Runs of neighbouring turns with one role: array<struct<role, texts>>."""

    def role_at(i: Column) -> Column:
        return F.element_at(turns, i)["role"]

    last = F.size(turns)
    heads = F.filter(
        F.sequence(F.lit(1), last),
        lambda i: (i == 1) | (role_at(i) != role_at(F.greatest(i - 1, F.lit(1)))),
    )

    def block(head: Column, behind: Column) -> Column:
        texts = F.transform(F.slice(turns, head, behind - head), lambda t: t["text"])
        return F.struct(role_at(head).alias("role"), texts.alias("texts"))

    def of(starts: Column) -> Column:
        following = F.concat(F.slice(starts, 2, F.size(starts)), F.array(last + 1))
        return F.zip_with(starts, following, block)

    return let(heads, of)


def _pieces(blocks: Column) -> Column:
    """What is written one after the other: array<struct<piece, role>>; role only at texts."""
    no_role = F.lit(None).cast("string")

    def mark(piece: Column) -> Column:
        return F.struct(piece.alias("piece"), no_role.alias("role"))

    def of_block(block: Column) -> Column:
        def text(t: Column, i: Column) -> Column:
            opening = F.concat(F.lit(START), _escape_role(block["role"]), F.lit("\n"))
            before = F.when(i == 0, opening)
            piece = F.struct(escape(t).alias("piece"), block["role"].alias("role"))
            return F.array(mark(before.otherwise(F.lit(PART))), piece)

        return F.concat(
            F.flatten(F.transform(block["texts"], text)), F.array(mark(F.lit(f"{END}\n")))
        )

    return F.flatten(F.transform(blocks, of_block))


def format_conversations(
    turns: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``loss`` and ``n_blocks``.

    ``turns`` has ``conv_id``, ``turn``, ``role`` and ``text``. ``loss`` is an
    array<struct<start, end>> of code points, one span per trained text, in order.
    """
    # Rows without an id share nothing, however many there are.
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    rows = turns.select(
        "conv_id",
        alone.alias("alone"),
        F.struct(
            F.col("turn").cast("bigint").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("row"),
    )
    collected = rows.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("row")).alias("turns"))

    def written(pieces: Column) -> Column:
        lengths = F.transform(pieces, lambda p: F.length(p["piece"]))
        spans = F.zip_with(
            pieces,
            start_offsets(lengths),
            lambda p, start: F.struct(
                p["role"].alias("role"),
                start.alias("start"),
                (start + F.length(p["piece"])).alias("end"),
            ),
        )
        loss = F.filter(spans, lambda s: F.coalesce(s["role"].isin(*trained_roles), F.lit(False)))
        return F.struct(
            F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("formatted"),
            F.transform(loss, lambda s: F.struct(s["start"], s["end"])).alias("loss"),
        )

    def out(blocks: Column) -> Column:
        return F.struct(
            let(_pieces(blocks), written).alias("written"), F.size(blocks).alias("n_blocks")
        )

    return collected.select(
        "conv_id", let(F.col("turns"), lambda t: let(_blocks(t), out)).alias("out")
    ).select("conv_id", "out.written.formatted", "out.written.loss", "out.n_blocks")


def _texts(formatted: Column) -> Column:
    """The texts as they are written: array<struct<role, text, start, end>>, in order.

    Blocks are split off at their markers, and their lengths added up.
    """

    def of_block(block: Column, start: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        body = F.regexp_replace(block, r"^[^\n]*\n", "")
        texts = F.split(F.regexp_replace(body, r"<\|im_end\|>\n$", ""), r"<\|im_part\|>", -1)

        def located(parts: Column) -> Column:
            before = start_offsets(F.transform(parts, lambda t: F.length(t) + len(PART)))
            base = start + len(START) + F.length(head) + 1

            def of_text(role: Column) -> Column:
                return F.zip_with(
                    parts,
                    before,
                    lambda t, at: F.struct(
                        role.alias("role"),
                        t.alias("text"),
                        (base + at).alias("start"),
                        (base + at + F.length(t)).alias("end"),
                    ),
                )

            return let(_unescape_role(head), of_text)

        return let(texts, located)

    blocks = F.split(formatted, r"<\|im_start\|>", -1)
    # Nothing stands in front of the first marker.
    written = F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0)))

    def of(found: Column) -> Column:
        starts = start_offsets(F.transform(found, lambda b: F.length(b) + len(START)))
        return F.flatten(F.zip_with(found, starts, of_block))

    return let(written, of)


def read_turns(formatted: Column) -> Column:
    """The turns written in a formatted conversation: array<struct<role, text>>."""
    return F.transform(
        _texts(formatted),
        lambda t: F.struct(t["role"].alias("role"), unescape(t["text"]).alias("text")),
    )


def loss_text(
    formatted: Column, loss: Column, trained_roles: tuple[str, ...] = ("assistant",)
) -> Column:
    """All text under the loss mask, unescaped, nothing between.

    The texts that lie exactly under the spans of the mask are read in one pass; a mask
    with other spans than the texts of the trained roles is cut out span by span.
    """

    def exact(texts: Column) -> Column:
        own = F.filter(texts, lambda t: t["role"].isin(*trained_roles))
        spans = F.transform(own, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
        written = F.array_join(F.transform(own, lambda t: unescape(t["text"])), "")
        return F.when(spans == loss, written)

    def piecewise(span: Column) -> Column:
        return unescape(F.substring(formatted, span["start"] + 1, span["end"] - span["start"]))

    return F.coalesce(
        let(_texts(formatted), exact), F.array_join(F.transform(loss, piecewise), "")
    )
