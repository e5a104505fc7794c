import numpy as np
import pytest

from gridtally.llm import topk, vectors
from gridtally.llm.components import smallest_linked
from tests.conftest import TESTDATA

SCHEMA = "vec_id long, embedding array<float>"


def _clusters(n, seed, spread, length=64):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 4, length))
    picked = centres[rng.integers(0, len(centres), n)]
    return picked + spread * rng.standard_normal((n, length))


def _brute(points):
    unit = vectors.unit(points)
    near = unit @ unit.T >= vectors.MIN_COSINE
    np.fill_diagonal(near, False)
    return near


@pytest.mark.parametrize("bucket_rows", [1024, 4])
def test_recall_and_precision(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(vectors, "BUCKET_ROWS", bucket_rows)
    # At this spread cosines lie around the threshold, the hardest case.
    points = _clusters(800, 1, 0.33).astype(np.float32).astype(np.float64)
    rows = [(i + 10, p.tolist()) for i, p in enumerate(points)]
    found = {
        r.vec_id: r for r in vectors.near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    }
    near = _brute(points)
    links = np.array([found[i + 10].n_links for i in range(800)])
    assert near.sum() > 300
    assert (links <= near.sum(axis=1)).all()
    assert links.sum() >= 0.98 * near.sum()
    for r in found.values():
        assert found[r.component_id].component_id == r.component_id <= r.vec_id
        assert r.kept == (r.vec_id == r.component_id)


def test_close_groups_are_found_whole(spark):
    points = _clusters(600, 2, 0.05).astype(np.float32).astype(np.float64)
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    found = {r.vec_id: r for r in vectors.near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    near = _brute(points)
    root = smallest_linked(600, [np.nonzero(near)])
    assert [found[i].n_links for i in range(600)] == near.sum(axis=1).tolist()
    assert [found[i].component_id for i in range(600)] == root.tolist()


def test_edges(spark):
    nan = float("nan")
    rows = [
        (1, [1.0, 0.0, 0.0]), (2, [1.0, 0.1, 0.0]), (1, [1.0, 0.0, 0.0]), (None, [2.0, 0.0, 0.0]),
        (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [None, 1.0]),
        (8, [1.0, 0.0]), (9, [float("inf"), 0.0]), (10, [3e38, 3e38]), (11, [1e-38, 1e-38]),
    ]
    frame = spark.createDataFrame([(*r, 0, 5) for r in rows], f"{SCHEMA}, n_links int, node int")
    out = sorted(map(tuple, vectors.near_duplicate_vectors(frame).collect()), key=str)
    assert out == sorted(
        [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (None, 3, 1, False)]
        + [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)]
        + [(10, 1, 10, True), (11, 1, 10, False)],
        key=str,
    )
    assert vectors.near_duplicate_vectors(frame.limit(0)).collect() == []


def _best(points, ids, queries, k):
    whole = [[int(np.floor(float(x) * 1024)) for x in p] for p in points]
    out = []
    for q in queries:
        own = whole[ids.index(q)]
        scored = sorted(
            (-sum(a * b for a, b in zip(own, w)), i) for w, i in zip(whole, ids) if i != q
        )
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("shard_rows", [8192, 90])
def test_top_k_equals_brute_force(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard_rows)
    points = _clusters(500, 3, 0.3, 8).astype(np.float32)
    points[100:160] = points[7]  # ties
    ids = list(range(500))
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in zip(ids, points)], SCHEMA)
    found = topk.top_k(frame, frame.where("vec_id % 20 = 0 or vec_id = 7"), 10)
    expected = _best(points, ids, [i for i in ids if i % 20 == 0 or i == 7], 10)
    assert sorted(map(tuple, found.collect())) == sorted(expected)


@pytest.mark.parametrize("shard_rows", [8192, 3])
def test_rows_that_share_an_id_are_rows_of_their_own(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard_rows)
    rng = np.random.default_rng(4)
    rows = [(i // 2, rng.standard_normal(4).astype(np.float32).tolist()) for i in range(12)]
    rows += [rows[0]] * 3 + [(100, rows[0][1])]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = topk.top_k(frame, frame.where("vec_id in (0, 3)"), 5).collect()
    whole = [[int(np.floor(x * 1024)) for x in v] for _, v in rows]
    expected = []
    for at, (q, _) in enumerate(rows):
        if q in (0, 3):
            scored = sorted(
                (-sum(a * b for a, b in zip(whole[at], w)), i)
                for n, ((i, _), w) in enumerate(zip(rows, whole)) if n != at
            )
            expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:5])]
    assert sorted(map(tuple, found)) == sorted(expected)


def test_top_k_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 1.0]), (1, [1.0]), (2, []), (3, None), (4, [nan]), (5, [1e25, 1.0]), (None, [9.0]), (6, [-1.0, 0.0])]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], f"{SCHEMA}, score int, shard int")
    out = sorted(map(tuple, topk.top_k(frame, frame.where("vec_id in (0, 3, 4, 5)"), 3).collect()))
    big = 2**63 - 1
    assert out[:3] == [(0, 1, 5, big), (0, 2, 1, 2**20), (0, 3, 2, 0)]
    assert [r[:3] for r in out[3:]] == [(5, 1, 0), (5, 2, 1), (5, 3, 2)]
    assert topk.top_k(frame.limit(0), frame.limit(0)).collect() == []
    assert topk.top_k(frame.where("vec_id = 0"), frame.where("vec_id = 0")).collect() == []


def test_top_k_of_the_given_table(spark):
    frame = spark.read.parquet(f"{TESTDATA}/sf0.01/embeddings.parquet")
    table = frame.toPandas().sort_values("vec_id")
    ids = table["vec_id"].tolist()
    queries = [i for i in ids if i % 100 == 0]
    found = topk.top_k(frame, frame.where("vec_id % 100 = 0"))
    assert sorted(map(tuple, found.collect())) == sorted(_best(list(table["embedding"]), ids, queries, 10))


@pytest.mark.parametrize("length", [1, 2, 3, 8, 16, 64, 100])
def test_filters_meet_at_the_threshold(length):
    """Pairs at a cosine of just over 0.9, in few and in many dimensions."""
    rng = np.random.default_rng(length)
    one = vectors.unit(rng.standard_normal((200, length)))
    other = one
    if length > 1:
        away = rng.standard_normal((200, length))
        away -= (away * one).sum(axis=1)[:, None] * one
        other = 0.9001 * one + np.sqrt(1 - 0.9001**2) * vectors.unit(away)
    pairs = zip(vectors.filters(one), vectors.filters(other))
    assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in pairs]) >= 0.97
