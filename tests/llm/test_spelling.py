import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from gridtally.llm import queries, spelling

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def brute_words(rows, slip_every=None, min_length=5, min_count=3):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(UPPER, UPPER.lower()))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if slip_every and h % slip_every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}


def brute_variants(counts):
    """By the forms with a place blanked or left out; nothing is walked."""
    blanked, shorter = defaultdict(list), defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            blanked[w[:k] + "\0" + w[k + 1 :]].append(w)
            shorter[w[:k] + w[k + 1 :]].add(w)
    near = {w: set() for w in counts}
    for group in blanked.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    for w in counts:
        for longer in shorter.get(w, ()):
            near[w].add(longer)
            near[longer].add(w)
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda x: (-counts[x], x))
            if counts[best] >= 2 * counts[w]:
                form[w] = best
    rows = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        rows.add((w, form.get(w), root, n, len(near[w]), counts.get(form.get(w))))
    return rows


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def found(frame):
    rows = [tuple(r) for r in frame.select(*COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def spellings_of(seed, size, letters, lengths):
    pick = random.Random(seed)
    words = {"".join(pick.choices(letters, k=pick.choice(lengths))) for _ in range(size)}
    for w in list(words)[: size // 2]:
        k = pick.randrange(len(w))
        words |= {w[:k] + w[k + 1 :], w[:k] + pick.choice(letters) + w[k:], w[:k] + pick.choice(letters) + w[k + 1 :]}
    return {w: pick.choice([3, 4, 7, 9, 20, 50, 200]) for w in words if w}


@pytest.mark.parametrize(
    "counts",
    [
        spellings_of(1, 400, "ab", [1, 2, 3, 4, 5, 6, 7, 8]),
        spellings_of(2, 300, "aébÿ", [4, 5, 6]),
        spellings_of(3, 60, "ab", [45, 47, 48, 49, 50, 51, 70, 300]),
    ],
)
def test_equals_brute_force(spark, counts):
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found(spelling.variants(words)) == brute_variants(counts)


def test_form_chain_and_ties(spark):
    counts = {"words": 3, "worda": 8, "wordb": 8, "worba": 16, "xorba": 40, "alone": 5}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = {r["word"]: r for r in spelling.variants(words).collect()}
    assert rows["words"]["form"] == "worda"  # as often as wordb, smaller
    assert rows["words"]["root"] == "xorba" and rows["words"]["n_near"] == 2
    assert rows["alone"]["form"] is None and rows["alone"]["root"] == "alone"


DOCS = [
    (1, "Fünf Wörter, WÖRTER wörter; naïve naïve naïve" * 3), (2, None), (3, ""), (None, "wörter wörter wörter"),
    (4, "a bb ccc" * 9), (4, "a bb ccc" * 9), (5, "lettersÀ" * 500 + " letters letters letters"),
    *[(i, "alpha beta gamma delta epsilon " * 40) for i in range(6, 90)],
]


def test_corpus_words(spark):
    docs = spark.createDataFrame([(i, t, 9, "w") for i, t in DOCS], "doc_id long, text string, n long, word string")
    for slip_every in (None, 5):
        mine = spelling.corpus_words(docs, slip_every=slip_every)
        assert {r["word"]: r["n"] for r in mine.collect()} == brute_words(DOCS, slip_every)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.corpus_words(docs)).collect() == []
    short = spark.createDataFrame([(1, "one of")], "doc_id long, text string")
    assert spelling.variants(spelling.corpus_words(short)).collect() == []


def test_ratio_that_goes_in_circles(spark):
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], "word string, n long"), ratio=1)


def test_query(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    expected = brute_variants(brute_words(docs, slip_every=97))
    assert found(queries.op11_spelling(spark, sf_small)) == expected
