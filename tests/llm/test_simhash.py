import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridtally.llm import simhash
from gridtally.llm.components import components

DOCS = "doc_id long, text string"


def _plain(text, shingle=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lowered.encode().split()]
    if not words:
        return 0
    hashes = [
        xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42)
        for i in range(max(1, len(words) - shingle + 1))
    ]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _signed(code):
    return code - (1 << 64) if code >> 63 else code


def _groups(codes):
    """The smallest code reachable from each, comparing every pair."""
    codes = sorted(set(codes))
    unsigned = np.array(codes, np.int64).view(np.uint64)
    root = list(range(len(codes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(unsigned ^ unsigned[i]) <= 3):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return {code: codes[find(i)] for i, code in enumerate(codes)}


@pytest.mark.parametrize(
    "text", ["a", "A b", "a b c", "a b c d É", "", None, " \n", "x\x0by\x1cz w\x85v", "q " * 9, "w%d " * 3]
)
def test_fingerprint(spark, text):
    assert simhash.fingerprint(text) == _signed(_plain(text))
    row = spark.createDataFrame([(1, text)], DOCS).select(simhash.fingerprints(F.col("text"))).first()
    assert row[0] == _signed(_plain(text))


def test_long_text_is_read_whole():
    rng = random.Random(1)
    text = " ".join(str(rng.randint(0, 999)) for _ in range(80_000))
    words = text.split()
    hashes = np.array(
        [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)],
        np.uint64,
    )
    expected = sum(
        1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes)
    )
    assert simhash.fingerprint(text) == _signed(expected)


@pytest.mark.parametrize("node_rows", [2048, 64])
def test_links_equal_brute_force(spark, monkeypatch, node_rows):
    """Chains, balls of many codes around one, and far codes; also with nodes dealt out."""
    monkeypatch.setattr(simhash, "NODE_ROWS", node_rows)
    rng = random.Random(node_rows)
    codes = set()
    for _ in range(40):
        code = rng.getrandbits(64)
        for _ in range(25):
            codes.add(_signed(code))
            for _ in range(rng.randint(0, 5)):
                code ^= 1 << rng.randrange(64)
    centre = rng.getrandbits(64)
    codes |= {_signed(centre ^ rng.getrandbits(11)) for _ in range(1500)}
    codes |= {0, 7, -1, _signed(1 << 63)}
    frame = spark.createDataFrame([(c,) for c in codes], "code long")
    found = {r.node: r.root for r in components(simhash.link_fingerprints(frame)).collect()}
    assert {c: found.get(c, c) for c in codes} == _groups(codes)


def _rows():
    return [
        (4, "one two three four five"),
        (2, "One two three four five"),
        (9, "something else entirely is written here today"),
        (9, "something else entirely is written here today"),
        (9, "one two three four five"),
        (None, "one two three four five"),
        (None, "rows without an id"),
        (None, "rows without an id"),
        (5, None),
        (6, ""),
        (7, " "),
    ]


def test_components_and_representatives(spark):
    docs = spark.createDataFrame(
        [(*r, "x", i) for i, r in enumerate(_rows())], f"{DOCS}, root string, code long"
    )
    found = simhash.near_duplicates(docs).collect()
    groups = defaultdict(list)
    for r in found:
        assert simhash.hexadecimal is not None
        groups[r.component_id].append(r.doc_id)
    assert sorted(groups[2], key=str) == [2, 4, 9, None]
    assert groups[9] == [9, 9]
    assert sorted(groups[5]) == [5, 6, 7]
    assert groups[None] == [None, None]
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    # The text of id 9 that is near id 2 goes; rows of one id and text are one.
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(2, "One two three four five"), (9, _rows()[2][1]), (None, "rows without an id"), (5, None)],
        key=str,
    )


def test_no_rows(spark):
    docs = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(docs).collect() == []
    assert simhash.representatives(docs).collect() == []


def test_hexadecimal(spark):
    row = spark.range(1).select(
        *[simhash.hexadecimal(F.lit(v)).alias(str(i)) for i, v in enumerate((0, 255, -1))]
    ).first()
    assert tuple(row) == ("0" * 16, "0" * 14 + "ff", "f" * 16)


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(300)]
    hub = [(1000, i) for i in range(2000, 4000)]
    edges = spark.createDataFrame(chain + hub + [(7, 7), (1, 0)], "u long, v long")
    roots = {r.node: r.root for r in components(edges).collect()}
    assert all(roots[i] == 0 for i in range(301))
    assert all(roots[i] == 1000 for i in (1000, 2000, 3999))
