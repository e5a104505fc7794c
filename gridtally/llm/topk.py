"""Exact top-k search by inner product: a ball tree per shard, branch and bound.

Components become the integers floor(1024 * x). Vectors are dealt to shards of about
``SHARD_ROWS`` rows by a hash of their id, so copies spread. A task builds the ball tree
of its shard, then reads its queries one batch after the other. A query walks the nodes
in order of the largest inner product their ball allows, |q| * radius + <q, centre>, and
stops when that falls below its k-th score.

The k-th score is shared: each query first searches one shard, and takes the k-th score
found there along to all other shards, where only better or equal rows count.

Cases: vectors that are NULL or hold NULL or a non-finite component take no part, nor do
rows with a NULL id; an empty vector is a vector of zeros, and shorter vectors count as
filled up with zeros. Equal scores are ordered by id. Every query row is asked, and every
row but its own is a candidate, also one with the same id or the same vector: repeated
query rows get their hits each. A query that is no row of the table leaves out none unless
a row has its id and vector. Scores are exact; one outside the range of a long becomes the end of the range.
No rows give no rows. Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtally.llm.common import checkpointed

SCALE = 1024
#: Vectors of a shard, about, and of a leaf, at most.
SHARD_ROWS, LEAF_ROWS = 8192, 64

#: Sums of products below this are exact as doubles.
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1
_HIT = "ask long, query_id long, vec_id long, score long"


def whole(vectors: pd.Series) -> np.ndarray:
    """Rows of floor(1024 * x) as doubles, filled up with zeros to one length."""
    out = np.zeros((len(vectors), max(1, vectors.map(len).max())))
    for row, vector in zip(out, vectors):
        row[: len(vector)] = np.floor(np.asarray(vector, np.float64) * SCALE)
    return out


def _products(rows: np.ndarray, query: np.ndarray) -> list[int] | np.ndarray:
    """Exact inner products of each row with the query."""
    with np.errstate(over="ignore"):
        size = np.abs(rows).max(initial=0.0) * np.abs(query).max(initial=0.0) * len(query)
    if size < _EXACT:
        return (rows @ query).astype(np.int64)
    whole_query = [int(x) for x in query]
    sums = [sum(int(x) * y for x, y in zip(row, whole_query)) for row in rows]
    return [min(max(s, -_LONG - 1), _LONG) for s in sums]


class BallTree:
    """Balls around halves of halves of the rows, the root first."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.order = np.arange(len(rows))
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        #: Two child nodes, or the range of a leaf in ``order``.
        self.below: list[tuple[bool, int, int]] = []
        self._build(0, len(rows))
        self.centre_rows, self.radius = np.stack(self.centres), np.array(self.radii)

    def _build(self, start: int, end: int) -> int:
        rows = self.rows[self.order[start:end]]
        centre = rows.mean(axis=0)
        distance = np.linalg.norm(rows - centre, axis=1)
        node = len(self.below)
        self.centres.append(centre)
        self.radii.append(float(distance.max()))
        self.below.append((True, start, end))
        if end - start > LEAF_ROWS and distance.max() > 0:
            # Along the line from the row furthest out to the row furthest from that.
            one = rows[distance.argmax()]
            other = rows[np.linalg.norm(rows - one, axis=1).argmax()]
            middle = (end - start) // 2
            split = np.argpartition(rows @ (other - one), middle)
            self.order[start:end] = self.order[start:end][split]
            left = self._build(start, start + middle)
            right = self._build(start + middle, end)
            self.below[node] = (False, left, right)
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """At least the largest inner product of each query with any row of each node."""
        norms = np.linalg.norm(queries, axis=1)[:, None]
        reach = norms * (self.radius + np.linalg.norm(self.centre_rows, axis=1))
        # Some more, against rounding.
        return queries @ self.centre_rows.T + norms * self.radius + 1e-9 * reach + 1.0

    def search(
        self, own_id: int | None, query: np.ndarray, bounds: np.ndarray, k: int, known: float
    ) -> list[tuple[int, int]]:
        """The best (score, -id) of the rows whose score is at least ``known``.

        With ``own_id`` one row of that id that equals the query, its own, is left out.
        """
        best: list[tuple[int, int]] = []
        nodes = [(-bounds[0], 0)]
        while nodes:
            bound, node = heapq.heappop(nodes)
            least = max(known, best[0][0]) if len(best) == k else known
            if -bound < least:
                break
            leaf, first, second = self.below[node]
            if not leaf:
                for child in (first, second):
                    heapq.heappush(nodes, (-bounds[child], child))
                continue
            at = self.order[first:second]
            for row, score, vec_id in zip(at, _products(self.rows[at], query), self.ids[at]):
                if score < least:
                    continue
                if own_id is not None and vec_id == own_id and (self.rows[row] == query).all():
                    own_id = None
                    continue
                hit = (int(score), -int(vec_id))
                if len(best) < k:
                    heapq.heappush(best, hit)
                else:
                    heapq.heappushpop(best, hit)
        return best


def _search(k: int):
    """Searches rows sorted by shard, each shard's vectors in front of its queries."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, pending, tree = None, [], None
        for batch in batches:
            for (at, asks), rows in batch.groupby(["shard", "asks"], sort=True):
                if at != shard:
                    shard, pending, tree = at, [], None
                if not asks:
                    pending.append((rows["vec_id"].to_numpy(), rows["embedding"]))
                    continue
                if tree is None and pending:
                    vectors = whole(pd.concat([v for _, v in pending], ignore_index=True))
                    tree = BallTree(np.concatenate([i for i, _ in pending]), vectors)
                if tree is not None:
                    yield _answers(tree, rows, k)

    return search


def _answers(tree: BallTree, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    queries = whole(rows["embedding"])
    width = max(queries.shape[1], tree.rows.shape[1])
    queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    if width > tree.rows.shape[1]:
        # Further components meet zeros.
        queries = queries[:, : tree.rows.shape[1]]
    bounds = tree.bounds(queries)
    known = rows["known"].to_numpy(dtype=np.float64, na_value=-np.inf)
    # A long that no double equals may have been rounded up.
    known = np.where(np.abs(known) < _EXACT, known, np.nextafter(known, -np.inf))
    # A row lies in the shard that its id and vector name, and so do its copies.
    own_ids = [i if at == own else None for i, at, own in zip(rows["vec_id"], rows["shard"], rows["own"])]
    hits = [
        (int(ask), int(query_id), -minus_id, score)
        for ask, query_id, own_id, query, bound, least in zip(
            rows["ask"], rows["vec_id"], own_ids, queries, bounds, known
        )
        for score, minus_id in tree.search(own_id, query, bound, k, least)
    ]
    return pd.DataFrame(hits, columns=["ask", "query_id", "vec_id", "score"])


def _usable(vector: Column) -> Column:
    def finite(x: Column) -> Column:
        return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))

    return F.coalesce(F.forall(vector, finite), F.lit(False))


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of each query with their rank."""
    order = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score``: the best ``k`` of other vectors.

    Both inputs have ``vec_id`` and ``embedding``. A query leaves out its own row, the one
    of the same id and vector.
    """
    usable = F.col("vec_id").isNotNull() & _usable(F.col("embedding"))
    rows = vectors.where(usable).select("vec_id", "embedding")
    n_shards = max(1, -(-rows.count() // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n_shards)).cast("int")
    nothing = F.lit(None).cast("long")
    stored = rows.select(
        shard.alias("shard"), F.lit(False).alias("asks"), "vec_id", "embedding",
        nothing.alias("known"), nothing.alias("ask"), nothing.alias("own"),
    )
    # Numbered and written: both searches must mean the same row by a number.
    asked = checkpointed(
        queries.where(usable).select(
            "vec_id",
            "embedding",
            F.monotonically_increasing_id().alias("ask"),
            shard.cast("long").alias("own"),
        )
    )
    home = F.pmod(F.xxhash64("ask"), F.lit(n_shards)).cast("int")

    def searched(questions: DataFrame) -> DataFrame:
        both = stored.unionByName(
            questions.select(
                "shard", F.lit(True).alias("asks"), "vec_id", "embedding", "known", "ask", "own"
            )
        )
        return (
            both.repartition("shard")
            .sortWithinPartitions("shard", "asks")
            .mapInPandas(_search(k), _HIT)
        )

    first = checkpointed(
        _best(searched(asked.withColumns({"shard": home, "known": nothing})), k).drop("rank")
    )
    kth = first.groupBy("ask").agg(F.when(F.count("*") >= k, F.min("score")).alias("known"))
    shards = F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))
    others = (
        asked.join(kth, "ask", "left")
        .select("vec_id", "embedding", "known", "ask", "own", home.alias("home"), shards.alias("shard"))
        .where("shard <> home")
    )
    return _best(first.unionByName(searched(others)), k).select(
        "query_id", "rank", "vec_id", "score"
    )
