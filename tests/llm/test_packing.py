import random
from collections import Counter

import pytest

from gridtally.llm import packing

DOCS = "doc_id long, text string"


def _check(sizes, bins, lengths):
    assert sorted(i for b in bins for i in b.items) == list(range(len(sizes)))
    for b in bins:
        assert b.used == sum(sizes[i] for i in b.items) <= b.capacity
        assert b.capacity == min(n for n in lengths if n >= b.used)


@pytest.mark.parametrize("seed", range(5))
def test_every_piece_is_in_one_bin(seed):
    rng = random.Random(seed)
    lengths = tuple(sorted(rng.sample(range(10, 200), 3)))
    sizes = [rng.randint(1, lengths[-1]) for _ in range(500)]
    bins = packing.pack(sizes, lengths)
    _check(sizes, bins, lengths)
    assert sum(sizes) / sum(b.capacity for b in bins) > 0.85


def test_lengths_are_chosen_jointly():
    # Two of 60 fill 120 and leave nothing; one in 100 would leave 40.
    bins = packing.pack([60] * 10, (100, 120), bin_cost=0)
    assert [b.capacity for b in bins] == [120] * 5
    # Nothing goes with 90, so it is cheapest alone in 100.
    assert [b.capacity for b in packing.pack([90] * 3, (100, 120), bin_cost=0)] == [100] * 3
    # A bin opened long is downsized to what it holds.
    assert [b.capacity for b in packing.pack([5], (10, 50))] == [10]


def test_close_to_the_best_possible():
    """Against every way to group a few pieces."""

    def cost(groups, lengths):
        return sum(min(n for n in lengths if n >= sum(g)) + packing.BIN_COST for g in groups)

    def groupings(rest):
        if not rest:
            yield []
            return
        first, *others = rest
        for groups in groupings(others):
            yield [[first], *groups]
            for i, group in enumerate(groups):
                if sum(group) + first <= 64:
                    yield [*groups[:i], [first, *group], *groups[i + 1 :]]

    rng, lengths = random.Random(4), (16, 32, 64)
    for _ in range(20):
        sizes = [rng.randint(1, 64) for _ in range(7)]
        best = min(cost(g, lengths) for g in groupings(sizes))
        mine = cost([[sizes[i] for i in b.items] for b in packing.pack(sizes, lengths)], lengths)
        assert mine <= 1.35 * best


def test_documents(spark):
    rng = random.Random(6)
    texts = [" ".join(f"{i}w{n}" for n in range(rng.randint(0, 900))) for i in range(120)]
    texts += [None, "", " \n ", "  a\tb  ", "x " * 5000]
    rows = [*enumerate(texts), (7, texts[7]), (None, "no id")]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], f"{DOCS}, words int, shard string")
    bins = packing.packed(docs, lengths=(64, 256, 1024), shard_words=10_000).collect()
    assert len({b.shard for b in bins}) > 3
    words = Counter()
    for b in bins:
        assert b.words == sum(p.words for p in b.pieces) <= b.length
        assert b.length in (64, 256, 1024)
        assert b.doc_ids == [p.doc_id for p in b.pieces]
        assert len(b.text.split()) == b.words
        words.update(b.text.split())
    expected = Counter(w for _, t in rows for w in (t or "").split())
    assert words == expected
    pieces = sorted(p.piece for b in bins for p in b.pieces if p.doc_id == 124)
    assert pieces == [0, 1, 2, 3, 4]


def test_equal_rows_spread_over_shards(spark):
    docs = spark.createDataFrame([(1, "a b c d")] * 3000, DOCS)
    bins = packing.packed(docs, lengths=(16, 64), shard_words=1000).collect()
    by_shard = Counter()
    for b in bins:
        by_shard[b.shard] += b.words
    assert len(by_shard) == 12 and max(by_shard.values()) < 2000
    assert sum(by_shard.values()) == 12_000


def test_no_rows(spark):
    docs = spark.createDataFrame([], DOCS)
    assert packing.packed(docs).collect() == []
    assert packing.packed(spark.createDataFrame([(1, None), (2, " ")], DOCS)).collect() == []
