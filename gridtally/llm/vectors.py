"""Near-duplicate vectors by spherical-cap filters from random product codes.

Two vectors are linked if their cosine is at least ``MIN_COSINE``. A product code splits
a randomly rotated vector into two halves and has some random directions for each; every
pair of directions is one filter, the cap around their sum. A vector joins all filters
whose score is within ``MARGIN`` of its best one. These are found by list decoding: a
direction of one half is looked at only if the best of the other half can still lift it
over the threshold. ``CODES`` independent codes are used. Vectors meet in the filters
they share, and every candidate pair is verified with its cosine in double precision.

On random unit vectors of 64 components a pair at a cosine of just 0.9 shares a filter
with a probability of 0.997, a closer pair nearly always; tests measure the recall.

Equal vectors count as one class from the start. A pair that shares several filters is
counted in the smallest one only, so the links of a vector can be added up without
listing pairs: each filter returns sums and a spanning forest. A filter of more than
``BUCKET_ROWS`` vectors is dealt out as pairs of parts.

Cases: a vector that is NULL, all zero or empty, or holds NULL or a non-finite component
is linked with nothing. Vectors of different lengths are never linked. Rows with a NULL
id are linked like any other; the component of a group is its smallest id. Repeated rows
are vectors of their own. No rows give no rows. Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtally.llm.common import checkpointed
from gridtally.llm.components import components, smallest_linked

MIN_COSINE = 0.9
#: Independent product codes, and directions a half has in each, at most.
CODES, DIRECTIONS = 3, 256
#: How far below the best filter's score a filter may be, in standard deviations of the
#: score of a random filter.
MARGIN = 0.3
SEED = 11
#: Vectors of a filter that one task compares with each other.
BUCKET_ROWS = 1024

_DECODED = 256


def usable(vector: Column) -> Column:
    """Whether a vector is neither NULL, zero or empty nor holds a NULL or non-finite part."""

    def finite(x: Column) -> Column:
        return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))

    return F.coalesce(
        F.forall(vector, finite) & F.exists(vector, lambda x: F.coalesce(x != 0, F.lit(False))),
        F.lit(False),
    )


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, safe for components of any size."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


@cache
def _codes(length: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per code a rotation and the directions of both halves."""
    rng = np.random.default_rng([SEED, length])
    half = (length + 1) // 2
    # A half of few components has few directions that differ, one of one component two.
    n = min(DIRECTIONS, 4**half)

    def directions() -> np.ndarray:
        if half == 1:
            return np.array([[1.0], [-1.0]])
        drawn = rng.standard_normal((n, half))
        return drawn / np.linalg.norm(drawn, axis=1, keepdims=True)

    return [
        (np.linalg.qr(rng.standard_normal((2 * half, 2 * half)))[0], directions(), directions())
        for _ in range(CODES)
    ]


def filters(vectors: np.ndarray) -> list[np.ndarray]:
    """The sorted numbers of the filters that each unit vector joins."""
    length = vectors.shape[1]
    padded = np.pad(vectors, ((0, 0), (0, length % 2)))
    half = padded.shape[1] // 2
    rows, numbers = [], []
    for code, (rotation, left, right) in enumerate(_codes(length)):
        turned = padded @ rotation
        a = turned[:, :half] @ left.T * np.sqrt(half)
        b = turned[:, half:] @ right.T * np.sqrt(half)
        best = b.max(axis=1)
        least = a.max(axis=1) + best - MARGIN
        row, i = np.nonzero(a >= (least - best)[:, None])
        at, j = np.nonzero(b[row] >= (least[row] - a[row, i])[:, None])
        rows.append(row[at])
        numbers.append(((length * CODES + code) * DIRECTIONS + i[at]) * DIRECTIONS + j)
    row, number = np.concatenate(rows), np.concatenate(numbers)
    order = np.lexsort((number, row))
    ends = np.cumsum(np.bincount(row, minlength=len(vectors)))[:-1]
    return np.split(number[order], ends)


def _by_length(vectors: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and unit vectors, for each length of a vector."""
    lengths = vectors.map(len).to_numpy()
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        yield at, unit(np.stack(vectors.iloc[at].to_numpy()).astype(np.float64))


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for start in range(0, len(batch), _DECODED):
            part = batch.iloc[start : start + _DECODED].reset_index(drop=True)
            lists = np.empty(len(part), object)
            for at, vectors in _by_length(part["embedding"]):
                for place, numbers in zip(at, filters(vectors)):
                    lists[place] = numbers
            yield part.assign(filters=lists)


def _shares_smaller(
    lists: np.ndarray, a: np.ndarray, b: np.ndarray, rank: np.ndarray
) -> np.ndarray:
    """Whether rows ``a`` and ``b`` share one of the first ``rank[a]`` filters of ``a``."""
    shared = np.zeros(len(a), bool)
    open_ = np.flatnonzero(rank[a] > 0)
    step = 0
    while len(open_):
        own = lists[a[open_], step]
        shared[open_] = (lists[b[open_]] == own[:, None]).any(axis=1)
        step += 1
        open_ = open_[~shared[open_] & (rank[a[open_]] > step)]
    return shared


def _compare(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums and forest of the links that belong to the filters of these rows."""
    group = rows.groupby(["filter", "part", "other"], sort=False).ngroup().to_numpy()
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    part, own = rows["part"].to_numpy(), rows["own"].to_numpy()
    crossing = part != rows["other"].to_numpy()
    size = rows["filters"].map(len).to_numpy()
    lists = np.full((len(rows), size.max()), -1, np.int64)
    lists[np.arange(lists.shape[1]) < size[:, None]] = np.concatenate(rows["filters"].to_numpy())
    rank, copies = rows["rank"].to_numpy(), rows["copies"].to_numpy()
    weight = np.zeros(len(rows), np.int64)
    links = []
    for first, end in zip(starts, np.r_[starts[1:], len(rows)]):
        # All vectors of a filter have one length.
        vectors = unit(np.stack(rows["embedding"].iloc[first:end].to_numpy()).astype(np.float64))
        near = np.triu(vectors @ vectors.T >= MIN_COSINE - 1e-9, 1)
        if crossing[first]:
            near &= own[first:end, None] != own[None, first:end]
        a, b = np.nonzero(near)
        exact = np.einsum("ij,ij->i", vectors[a], vectors[b]) >= MIN_COSINE
        a, b = a[exact] + first, b[exact] + first
        if len(a):
            new = ~_shares_smaller(lists, a, b, rank)
            a, b = a[new], b[new]
            np.add.at(weight, a, copies[b])
            np.add.at(weight, b, copies[a])
            links.append((a, b))
    root = smallest_linked(len(rows), links)
    node = rows["node"].to_numpy()
    out = pd.DataFrame({"node": node, "root": node[root], "weight": weight})
    return out[weight > 0]


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reads rows sorted by filter; a filter may go on in the next batch."""
    keys = ["filter", "part", "other"]
    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        last = (rows[keys] == rows[keys].iloc[-1]).all(axis=1).to_numpy()
        cut = int(np.argmax(last)) if len(rows) else 0
        rest = rows.iloc[cut:]
        if cut:
            yield _compare(rows.iloc[:cut])
    if rest is not None and len(rest):
        yield _compare(rest)


def _linked(classes: DataFrame) -> DataFrame:
    """``node``, ``root`` and ``weight`` for every class with links, once per filter."""
    schema = classes.schema.simpleString().removeprefix("struct<").removesuffix(">")
    decoded = checkpointed(classes.mapInPandas(_decode, f"{schema},filters:array<bigint>"))
    entries = decoded.select("node", F.posexplode("filters").alias("rank", "filter"))
    sizes = entries.groupBy("filter").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / BUCKET_ROWS).cast("int")
    shared = entries.join(sizes, "filter").select(
        "node",
        "rank",
        "filter",
        F.pmod(F.xxhash64("node"), parts).cast("int").alias("own"),
        F.explode(F.sequence(F.lit(0), parts - 1)).alias("partner"),
    )
    keys = ("filter", "part", "other")
    return (
        shared.withColumn("part", F.least("own", "partner"))
        .withColumn("other", F.greatest("own", "partner"))
        .drop("partner")
        .join(decoded, "node")
        .repartition(*keys)
        .sortWithinPartitions(*keys)
        .mapInPandas(_verify, "node long, root long, weight long")
    )


def near_duplicate_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for each vector."""
    rows = vectors.select("vec_id", "embedding")
    classes = checkpointed(
        rows.where(usable(F.col("embedding")))
        .groupBy("embedding")
        .agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    linked = checkpointed(_linked(classes.select("node", "embedding", "copies")))
    roots = components(linked.select(F.col("node").alias("u"), F.col("root").alias("v")))
    weights = linked.groupBy("node").agg(F.sum("weight").alias("weight"))
    of_class = (
        classes.join(weights, "node", "left")
        .join(roots.withColumnRenamed("root", "found"), "node", "left")
        .select(
            "embedding",
            "least_id",
            F.coalesce("found", "node").alias("root"),
            (F.coalesce("weight", F.lit(0)) + F.col("copies") - 1).alias("links"),
        )
    )
    ids = of_class.groupBy("root").agg(F.min("least_id").alias("least"))
    found = of_class.join(ids, "root").select("embedding", "links", "least")
    component = F.coalesce("least", "vec_id")
    return rows.join(found, "embedding", "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
