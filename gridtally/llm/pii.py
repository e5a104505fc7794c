"""Personal data in texts, found with Spark expressions only.

Regular expressions propose spans, left to right and without overlap within a kind.
Validators confirm them: the parts of an address are at most 255, a card passes Luhn,
an account number passes mod 97, digits are counted. Words near a span adjust its score.

Two groups of kinds:

* email, ip, card, phone ("base"): every confirmed proposal is a span, whatever its score.
* iban, ssn, local_phone, birth_date: a confirmed proposal is a span if its score, with
  the words around it, reaches ``MIN_SCORE`` and it overlaps no span of the base.

The patterns use possessive repeats and look at run starts only where that cannot change
a match, so that a text of any length is read in linear time. Positions come from the
texts between the matches, whose lengths are added up; contexts and the pieces of redacted
texts are cut out of blocks of the text; spans are compared with their neighbours in order.
So many spans in one text take no more time each than few.

Cases: a NULL text is an empty one and has no spans. Offsets are code points, the end
exclusive. Every row is judged by itself; repeated rows and NULL ids need nothing special.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtally.llm.common import cut, let, running, start_offsets, text_blocks

MIN_SCORE = 0.6
#: Code points before and behind a span in which context words count.
BEFORE, BEHIND = 48, 24

SPAN = "struct<start:int,end:int,text:string>"
_MAIL = "A-Za-z0-9._%+-"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A text without a match of this has no span of the kind; it is quicker to test.
    hint: str
    base: bool
    score: float
    context: str
    gain: float = 0.4


KINDS = (
    Kind(
        "email",
        rf"(?:(?<![{_MAIL}])|\G)[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@",
        True,
        0.8,
        "mail|contact|write|courriel|correo",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"[0-9]\.[0-9]",
        True,
        0.6,
        r"\bip\b|address|server|host|login",
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        r"[0-9](?:[\x20-]?[0-9]){13}",
        True,
        0.6,
        "card|visa|master|credit|karte|carte|tarjeta",
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        r"\+[0-9]",
        True,
        0.6,
        "phone|call|tel|mobile|fax|cell",
    ),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+"
        r"(?![A-Za-z0-9])",
        r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}",
        False,
        0.8,
        "iban|account|bank|konto|compte|cuenta",
        0.2,
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        r"[0-9]-[0-9]{2}-[0-9]",
        False,
        0.3,
        r"\bssn\b|social security|tax id|taxpayer",
    ),
    Kind(
        "local_phone",
        r"(?<![0-9+(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9])",
        r"[0-9][.\x20-][0-9]{4}",
        False,
        0.3,
        r"phone|\bcall\b|\btel\b|mobile|\bfax\b",
    ),
    Kind(
        "birth_date",
        r"(?<![0-9-])(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9-])",
        r"[0-9]-[0-9]{2}-[0-9]",
        False,
        0.3,
        r"\bborn\b|birth|\bdob\b|geboren|nacid[oa]",
    ),
)
BASE = tuple(kind.name for kind in KINDS if kind.base)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit of a card is right: every second digit from the right doubles."""

    def value(digit: Column, i: Column) -> Column:
        n = F.ascii(digit) - 48
        doubled = F.when(n > 4, n * 2 - 9).otherwise(n * 2)
        return F.when(i % 2 == 1, doubled).otherwise(n)

    values = F.transform(F.split(F.reverse(digits), "", -1), value)
    return F.aggregate(values, F.lit(0), lambda total, n: total + n) % 10 == 0


def _mod_97(text: Column) -> Column:
    """Whether an account number leaves 1: letters count as 10 to 35, the head comes last."""
    plain = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.concat(plain.substr(F.lit(5), F.length(plain)), plain.substr(1, 4))

    def add(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code > 57, (rest * 100 + code - 55) % 97).otherwise(
            (rest * 10 + code - 48) % 97
        )

    return F.aggregate(F.split(turned, "", -1), F.lit(0), add) == 1


def _confirmed(kind: str, text: Column) -> Column:
    if kind == "ip":
        return text.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})(?:\.|$)){4}$")
    if kind == "card":
        return let(
            _digits(text),
            lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False)),
        )
    if kind == "phone":
        return F.length(_digits(text)).between(10, 15)
    if kind == "iban":
        n = F.length(F.replace(text, F.lit(" "), F.lit("")))
        return F.when(n.between(15, 34), _mod_97(text)).otherwise(F.lit(False))
    return F.lit(True)


def _located(text: Column, kind: Kind) -> Column:
    """All confirmed matches of a kind with their offsets: array of ``SPAN``."""
    gaps = F.split(text, kind.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    lengths = F.zip_with(
        gaps,
        found,
        lambda gap, match: F.array(F.length(gap), F.coalesce(F.length(match), F.lit(0))),
    )

    def spans(matches: Column) -> Column:
        starts = start_offsets(F.flatten(lengths))
        return F.zip_with(
            matches,
            F.filter(starts, lambda _, i: i % 2 == 1),
            lambda match, start: F.struct(
                start.alias("start"),
                (start + F.length(match)).alias("end"),
                match.alias("text"),
            ),
        )

    kept = F.filter(
        let(found, spans), lambda s: s["text"].isNotNull() & _confirmed(kind.name, s["text"])
    )
    return F.when(text.rlike(kind.hint), kept).otherwise(F.array().cast(f"array<{SPAN}>"))


def _scored(blocks: Column, length: Column, kind: Kind, spans: Column) -> Column:
    def score(s: Column) -> Column:
        first = F.greatest(s["start"] - BEFORE, F.lit(0))
        behind = F.least(s["end"] + BEHIND, length)
        around = F.concat(
            cut(blocks, first, s["start"]), F.lit("\n"), cut(blocks, s["end"], behind)
        )
        near = F.lower(around).rlike(kind.context)
        return F.least(
            F.lit(1.0), F.lit(kind.score) + F.when(near, F.lit(kind.gain)).otherwise(F.lit(0.0))
        )

    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("rank"),
            s["end"].alias("end"),
            F.lit(kind.name).alias("kind"),
            s["text"].alias("text"),
            score(s).alias("score"),
        ),
    )


def find_spans(docs: DataFrame, *carry: str) -> DataFrame:
    """One row per document: the columns ``carry``, ``text`` and its ``spans``.

    ``spans`` is an array<struct<start, rank, end, kind, text, score>> sorted by start,
    then kind (``rank`` is the place of the kind in ``KINDS``).
    """
    text = F.col("text")
    found = docs.select(*carry, F.coalesce(text, F.lit("")).alias("text"))
    # One generated row keeps the optimizer from putting these expressions into later filters.
    columns = F.struct(*[_located(text, kind).alias(f"_{kind.name}") for kind in KINDS])
    found = found.select("*", F.inline(F.array(columns)))
    located = [F.col(f"_{kind.name}") for kind in KINDS]
    some = F.lit(False)
    for spans in located:
        some = some | (F.size(spans) > 0)
    # Blocks are made once, and only of texts that have spans.
    none = F.array().cast("array<string>")
    found = found.withColumn("_blocks", F.when(some, text_blocks(F.col("text"))).otherwise(none))
    # Bound once: what stands inside a lambda is evaluated for each span.
    whole = F.struct(F.col("_blocks").alias("blocks"), F.length("text").alias("length"))
    every = let(
        whole,
        lambda w: F.concat(
            *[_scored(w["blocks"], w["length"], k, spans) for k, spans in zip(KINDS, located)]
        ),
    )
    return found.select(*carry, "text", let(F.array_sort(every), _kept).alias("spans"))


_BASE_RANKS = [rank for rank, kind in enumerate(KINDS) if kind.base]


def _kept(spans: Column) -> Column:
    """Spans, sorted, without those of the added kinds that score low or touch a base span."""

    def is_base(s: Column) -> Column:
        return s["rank"].isin(*_BASE_RANKS)

    # How far the base spans in front reach, and where the next one behind starts. A base
    # span comes before an added one that starts with it, as its kind does.
    reach = running(
        F.transform(spans, lambda s: F.when(is_base(s), s["end"]).otherwise(0)), F.lit(0), "int", F.greatest
    )
    far = F.lit((1 << 31) - 1)
    following = running(
        F.reverse(F.transform(spans, lambda s: F.when(is_base(s), s["start"]).otherwise(far))), far, "int", F.least
    )

    def apart(reach: Column) -> Column:
        def of(behind: Column) -> Column:
            def keeps(s: Column, i: Column) -> Column:
                free = (F.get(reach, i) <= s["start"]) & (F.get(behind, i) >= s["end"])
                return is_base(s) | ((s["score"] >= MIN_SCORE) & free)

            return F.filter(spans, keeps)

        return let(F.reverse(following), of)

    return F.when(F.size(spans) == 0, spans).otherwise(let(reach, apart))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its kind."""

    def of_spans(found: Column) -> Column:
        ends = running(F.transform(found, lambda s: s["end"]), F.lit(0), "int", F.greatest)
        # How far the spans in front of each go, and at last all of them.
        return let(ends, lambda reach: let(_heads(found, reach), lambda heads: of_runs(found, reach, heads)))

    def of_runs(found: Column, reach: Column, heads: Column) -> Column:
        """Each run's name and the text behind it, up to the next run."""
        following = F.concat(F.slice(heads, 2, F.size(heads)), F.array(F.size(found)))

        def of_text(whole: Column) -> Column:
            blocks, length = whole["blocks"], whole["length"]

            def piece(head: Column, behind: Column) -> Column:
                until = F.coalesce(F.get(found, behind)["start"], length)
                name = F.concat(F.lit("["), F.upper(F.get(found, head)["kind"]), F.lit("]"))
                return F.concat(name, cut(blocks, F.get(reach, behind), until))

            first = cut(blocks, F.lit(0), F.get(found, F.lit(0))["start"])
            return F.concat(first, F.array_join(F.zip_with(heads, following, piece), ""))

        return let(F.struct(text_blocks(text).alias("blocks"), F.length(text).alias("length")), of_text)

    return F.when(F.size(spans) == 0, text).otherwise(let(spans, of_spans))


def _heads(spans: Column, reach: Column) -> Column:
    """The places of the spans that overlap none in front of them."""
    own = F.transform(
        spans, lambda s, i: F.when((i == 0) | (s["start"] >= F.get(reach, i)), i)
    )
    return F.filter(own, lambda i: i.isNotNull())


def redact(docs: DataFrame) -> DataFrame:
    """The documents with their spans replaced; ``n_chars``, if there is one, follows.

    A NULL text stays NULL.
    """
    rows = docs.select(F.struct("*").alias("doc"), "text")
    found = find_spans(rows, "doc")
    text = F.when(F.col("doc.text").isNotNull(), redacted(F.col("text"), F.col("spans")))
    clean = found.select("doc", text.alias("clean"))
    put = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return clean.select(
        *[put.get(c, F.col("doc")[c]).alias(c) for c in docs.columns]
    )
