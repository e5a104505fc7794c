import random
import re

from gridtally.llm import licenses, queries

DOCS = "doc_id long, text string"


def _brute(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(licenses.WORD, lowered)
    places = []
    for label, phrase in licenses.BASE:
        phrase = phrase.split()
        places += [
            (i, label)
            for i in range(len(words) - len(phrase) + 1)
            if words[i : i + len(phrase)] == phrase
        ]
    return len(words), sorted(places)


def _scan(spark, texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    return [next(r for r in rows if r.doc_id == i) for i in range(len(texts))]


def test_base_equals_brute_force(spark):
    rng = random.Random(2)
    parts = "under the mit license apache version 2 cc by nc word é, . - CC-BY-NC The MIT".split()
    phrases = [p for _, p in licenses.BASE] + ["Apache License, Version 2.0"]
    texts = [
        " ".join(rng.choice(parts if rng.random() < 0.8 else phrases) for _ in range(rng.randint(0, 40)))
        for _ in range(250)
    ]
    texts += [None, "", "cc by", "cc by nc " * 5000, "cc by cc by nc nc", "under the\nMIT\tLicense" * 3]
    for text, row in zip(texts, _scan(spark, texts)):
        assert (row.n_words, [tuple(p) for p in row.base_places]) == _brute(text)


def _labels(row):
    return sorted({s.label for s in row.spans})


def test_notices(spark):
    notice = dict(licenses.NOTICES)["bsd"]
    words = notice.split()
    changed = " ".join(words[:9] + ["really"] + words[9:])
    half = " ".join(words[: len(words) // 2])
    found = _scan(
        spark,
        [
            f"x y {notice} z",
            changed,
            half,
            "Licensed under the GNU General Public License, version 3.",
            "ALL RIGHTS RESERVED",
            "all the rights are reserved",
        ],
    )
    assert [_labels(r) for r in found] == [["bsd"], ["bsd"], [], ["gpl-3"], ["all-rights-reserved"], []]
    span = found[0].spans[0]
    assert (span.start, span.end, span.coverage) == (2, 2 + len(words), 1.0)
    assert 0.85 <= found[1].coverage <= 1
    assert 0 < found[2].coverage < 0.85


def test_rows_come_back(spark):
    text = "cc by nc"
    rows = [(1, text), (1, text), (1, "other"), (None, text), (2, None), (3, text)]
    frame = spark.createDataFrame([(*r, "k", 1) for r in rows], f"{DOCS}, label string, h int")
    out = sorted(((r.doc_id, len(r.base_places)) for r in licenses.scan(frame).collect()), key=str)
    assert out == sorted([(1, 1), (1, 1), (1, 0), (None, 1), (2, 0), (3, 1)], key=str)
    assert licenses.scan(frame.limit(0)).collect() == []


def test_query_columns(spark, tmp_path):
    rows = [(1, "Released under the MIT License. CC BY-NC"), (2, "plain")]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    out = sorted(map(tuple, queries.QUERIES["op9_licenses"](spark, str(tmp_path)).collect()))
    assert out == [
        (1, 8, 2, 1, 5, "cc-by-nc,mit", "cc-by-nc,mit", 1.0),
        (2, 1, 0, None, None, "", "", 0.0),
    ]
