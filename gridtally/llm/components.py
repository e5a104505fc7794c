"""Connected components of a graph that only Spark holds.

Large-star and small-star steps alternate: a large-star step links the larger neighbours
of each node to the smallest one, a small-star step the smaller neighbours and the node
itself. Both keep the components and end in stars around the smallest node. A node's
neighbours are never collected; their minimum is an aggregate that combines before the
shuffle, and a hot node's edges meet it in a join that adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtally.llm.common import checkpointed


def smallest_linked(n: int, links: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of ``n`` rows of one task the smallest row that links reach.

    ``links`` are arrays of row pairs; they are read one after the other and not kept.
    """
    root = np.arange(n)
    for a, b in links:
        while True:
            low = np.minimum(root[a], root[b])
            apart = (root[a] != low) | (root[b] != low)
            if not apart.any():
                break
            a, b, low = a[apart], b[apart], low[apart]
            for side in (root[a], root[b], a, b):
                np.minimum.at(root, side, low)
            while (root[root] != root).any():
                root = root[root]
    return root


def _linked(edges: DataFrame, near: str, far: str) -> DataFrame:
    """Links ``far`` of each edge to the smallest of ``near`` and all its ``far``."""
    smallest = edges.groupBy(F.col(near).alias("_at")).agg(
        F.least(F.min(far), F.min(near)).alias("_least")
    )
    return edges.join(smallest, F.col(near) == F.col("_at"))


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, its component's smallest node, for every node with an edge.

    ``edges`` has two longs, ``u`` and ``v``. Edges may repeat, in either direction; an
    edge from a node to itself counts as none.
    """
    now = checkpointed(edges.where("u <> v").select(*_ordered(F.col("u"), F.col("v"))).distinct())
    state = _state(now)
    while state[0]:
        both = now.select("u", "v").union(now.select("v", "u"))
        large = _linked(both, "u", "v").where("v > u").select(F.col("v").alias("u"), F.col("_least").alias("v"))
        large = large.where("u <> v").distinct()
        hubs = _linked(large, "u", "v")
        small = hubs.select(F.col("v").alias("u"), F.col("_least").alias("v")).union(
            hubs.select("u", F.col("_least"))
        )
        now = checkpointed(small.where("u <> v").distinct())
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select("v", "v").distinct()
    )


def _state(edges: DataFrame) -> tuple:
    """Tells whether a step changed the edges."""
    digest = F.xxhash64("u", "v")
    row = edges.agg(F.count("*"), F.sum(digest.cast("decimal(38,0)"))).first()
    return tuple(row)
