"""Spans and redaction against Python's own regular expressions."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from gridtally.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and _luhn(digits)
    return kind != "phone" or 10 <= len(digits) <= 15


def _base(text):
    found = [
        (m.start(), order, m.end(), kind)
        for order, (kind, pattern) in enumerate(BASE.items())
        for m in re.finditer(pattern, text or "")
        if _valid(kind, m.group())
    ]
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def _spans(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find_spans(frame, "doc_id").collect()}
    return [[(s.kind, s.start, s.end) for s in rows[i].spans] for i in range(len(texts))]


def _texts():
    rng = random.Random(3)
    parts = (
        "a.b@c.de _x@d.ef x@y a@b.c.d.e @ 1.2.3.4 256.1.1.1 9.9.9.9.9 001.02.3.4 1.2.3.4.5.6.7.8 "
        "+1 (988) 555-2485 +49.30.1234567 +1 2 +123456789012345678 4041894974608795 4111-1111-1111-1111 "
        "4111 1111 1111 1112 12 é 😀 word + - . , \n 0000000000000000000"
    ).split(" ")
    return ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "-"]) for _ in range(rng.randint(0, 40))) for _ in range(300)]


def test_base_spans(spark):
    texts = _texts() + [None, "", "a" * 50_000, "1" * 50_000, "a@" + "b." * 9_000 + "c", "1.1.1.1 " * 3_000]
    for text, spans in zip(texts, _spans(spark, texts)):
        assert [s for s in spans if s[0] in pii.BASE] == _base(text)


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("DE89 3704 0044 0532 0130 00", ["iban"]),
        ("DE89 3704 0044 0532 0130 01", []),
        ("my ssn is 123-45-6789", ["ssn"]),
        ("number 123-45-6789", []),
        ("ssn 000-45-6789", []),
        ("call 555-123-4567", ["local_phone"]),
        ("code 555-123-4567", []),
        ("phone +1 (555) 123-4567", ["phone"]),
        ("born 1980-02-11", ["birth_date"]),
        ("on 1980-02-11", []),
    ],
)
def test_checksums_and_context(spark, text, kinds):
    assert [s[0] for s in _spans(spark, [text])[0]] == kinds


MIXED = "mail a@b.co to 1.2.3.4 ssn 123-45-6789 call 555-123-4567 or +1 (988) 555-2485, born 1980-02-11; "


def _seconds(run):
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def test_many_spans_take_linear_time(spark):
    def read(n):
        text = spark.createDataFrame([(1, MIXED * n)], "doc_id long, text string")
        spans = pii.find_spans(text, "doc_id").select(F.size("spans")).first()[0]
        clean = pii.redact(text).select(F.length("text")).first()[0]
        assert spans == 6 * n and 0 < clean < len(MIXED) * n

    read(10)
    few, many = (_seconds(lambda: read(n)) for n in (700, 5_600))
    assert many < 10 * few + 1


def test_contexts_and_cuts_across_blocks(spark):
    """Spans around the ends of the blocks that texts are cut from, against plain slicing."""
    texts = ["é😀"[i % 2] * (1024 * k - i) + MIXED * 12 for k in (1, 2) for i in range(0, 60, 7)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.find_spans(frame, "doc_id").collect()}
    clean = {r.doc_id: r.text for r in pii.redact(frame).collect()}
    for i, text in enumerate(texts):
        assert len(found[i]) == 72
        assert all(text[s.start : s.end] == s.text for s in found[i])
        expected, at = "", 0
        for s in found[i]:
            assert s.start >= at
            expected += text[at : s.start] + f"[{s.kind.upper()}]"
            at = s.end
        assert clean[i] == expected + text[at:]


def test_overlaps_of_many_spans(spark):
    """Added kinds next to, inside and around base spans, against a comparison of all pairs."""
    rng = random.Random(8)
    parts = ["ssn 123-45-6789", "123-45-6789@x.co", "call 555-123-4567 ", "1.2.3.4", "+1555-123-4567", " born 1980-02-11", "1980-02-11@b.co ", "x " * 40]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 60))) for _ in range(150)]
    for text, spans in zip(texts, _spans(spark, texts)):
        base = [s for s in spans if s[0] in pii.BASE]
        assert base == _base(text)
        assert spans == sorted(spans, key=lambda s: (s[1], [k.name for k in pii.KINDS].index(s[0])))
        for kind, start, end in spans:
            if kind not in pii.BASE:
                assert not any(a < end and start < b for _, a, b in base)


def test_redaction(spark):
    texts = ["to a@b.co, ok +1 (988) 555-2485", "none", None, "", "+4111111111111111 x", "1.2.3.4" * 2]
    frame = spark.createDataFrame(
        [(i, t, -1, "k") for i, t in enumerate(texts)],
        "doc_id long, text string, n_chars long, spans string",
    )
    out = pii.redact(frame)
    assert out.columns == frame.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[0].text == "to [EMAIL], ok [PHONE]"
    assert [rows[i].text for i in (1, 2, 3)] == ["none", None, ""]
    assert rows[4].text == "+[CARD] x"
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in rows.values())
    assert all(r.spans == "k" for r in rows.values())
    again = pii.find_spans(out.select("text")).where(F.size("spans") > 0)
    assert again.count() == 0
    assert pii.redact(frame.limit(0)).collect() == []
