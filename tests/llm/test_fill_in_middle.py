import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridtally.llm import boundary_sets as sets
from gridtally.llm import fill_in_middle as fim
from gridtally.llm import queries

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]")


def brute(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    tokens = TOKEN.findall(text)
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    if h[3] % 100 < 20:
        return (doc_id, n, "spm", len(p), len(p + m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(p + m), f"<P>{p}<S>{s}<M>{m}")


def key(row):
    return tuple((x is None, x) for x in row)


ODD = [
    (1, "one two, three"), (2, None), (3, ""), (4, "a <P> b"), (5, "<S"), (6, "<M>"), (None, "no id here"),
    (None, None), (7, "é𝄞ü x" * 50), (8, "ab" * 200_000 + " " + "1" * 70_000), (8, "again 8"), (8, "again 8"),
    *[(i, f"<<P {i} <S S> M> tail" + "\n\t" * (i % 3)) for i in range(9, 200)],
]


def test_equals_brute_force_and_comes_back(spark):
    docs = spark.createDataFrame(
        [(i, t, "x", "y") for i, t in ODD], "doc_id long, text string, output string, form string"
    )
    out = fim.fill_in_middle(docs)
    mine = out.select("doc_id", "n", "form", "first", "second", "output").collect()
    assert sorted(map(tuple, mine), key=key) == sorted((brute(*r) for r in ODD), key=key)
    back = out.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted(map(tuple, back), key=key) == sorted(((i, t or "") for i, t in ODD), key=key)
    assert {r["form"] for r in mine} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fim.fill_in_middle(docs).collect() == []


def test_marks_that_can_be_mistaken():
    with pytest.raises(ValueError):
        fim.Settings(prefix_mark="<<P>")
    with pytest.raises(ValueError):
        fim.Settings(prefix_mark="<S>")


def test_other_settings(spark):
    own = fim.Settings(seed=7, percent=100, spm_percent=100, prefix_mark="[pre]", suffix_mark="[suf]", middle_mark="[mid]")
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(20)], "doc_id long, text string")
    out = fim.fill_in_middle(docs, settings=own)
    rows = out.select("text", "output", "form", fim.restored(F.col("output"), F.col("form"), own).alias("back")).collect()
    assert all(r["form"] == "spm" and r["output"].startswith("[suf]") and r["back"] == r["text"] for r in rows)


def test_layouts():
    sparse = np.zeros(sets.SPAN, dtype=bool)
    sparse[[3, 900, 65_535]] = True
    runs = np.zeros(sets.SPAN, dtype=bool)
    runs[100:30_000] = runs[40_000:65_000] = True
    dense = np.arange(sets.SPAN) % 3 == 0
    for member, kind in (
        (sparse, sets.ArrayContainer), (runs, sets.RunContainer), (dense, sets.BitmapContainer),
    ):
        held = sets.container(member)
        assert isinstance(held, kind)
        places = np.flatnonzero(member)
        for rank in {0, 1, 2, len(places) // 2, len(places) - 1}:
            assert held.select(rank) == places[rank]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.integers(1, 50_000), st.booleans(), st.integers(1, 4)), max_size=8))
def test_select_equals_positions(pieces):
    parts = [np.arange(n) % step == 0 if on else np.zeros(n, dtype=bool) for n, on, step in pieces]
    member = np.concatenate([np.zeros(0, dtype=bool), *parts])
    held, places = sets.BoundarySet(member), np.flatnonzero(member)
    assert len(held) == len(places)
    for rank in np.unique(np.linspace(0, max(len(places) - 1, 0), 40).astype(int)):
        if len(places):
            assert held.select(int(rank)) == places[rank]
    with pytest.raises(IndexError):
        held.select(len(places))


@settings(deadline=None, max_examples=100)
@given(st.text())
def test_boundaries(text):
    ends = np.cumsum([0, *map(len, TOKEN.findall(text))])
    held = sets.token_boundaries(text)
    assert [held.select(i) for i in range(len(held))] == list(ends)


def test_query_columns(spark, sf_small):
    rows = queries.op13_fill_in_middle(spark, sf_small)
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    expected = []
    for doc_id, text in docs:
        _, n, form, first, second, output = brute(doc_id, text)
        middle = None if first is None else second - first
        sha = [hashlib.sha256(t.encode()).hexdigest() for t in (output, text or "")]
        expected.append((doc_id, n, form, first, middle, *sha))
    assert sorted(map(tuple, rows.collect()), key=key) == sorted(expected, key=key)
