"""Near duplicates by 64-bit fingerprints of word shingles.

A fingerprint has a bit set if it is set in over half of the hashes of the text's
shingles. Texts whose fingerprints differ in at most ``MAX_BITS`` bits are linked, and
linked texts form one group.

Search, an index over Gray-ordered fingerprints:

* Equal fingerprints count as one from the start.
* Top nodes are shared masked bit patterns. The 64 bits fall into five blocks; two
  fingerprints with at most three different bits agree on at least two whole blocks, so
  each fingerprint joins the ten nodes that mask two blocks. Spark shuffles by node; a
  node of more than ``NODE_ROWS`` rows is dealt out as pairs of parts, which meet in
  tasks of their own. Every pair within the distance meets in at least one node.
* Inside a node fingerprints are sorted by Gray rank, so that neighbours share most bits.
  Runs of ``FAN_OUT`` neighbours get a parent that holds the bits on which all of them
  agree, and so on up to one root. A search walks down with the number of differing bits
  so far, each bit counted in the highest node that holds it, and drops a whole group
  as soon as that number exceeds the limit.

A node returns a spanning forest of the links it found, never the links themselves;
components join the forests.

Cases: a NULL or blank text has fingerprint zero and is linked like any other. Rows with
NULL ids have a fingerprint and belong to a group; the group's id is the smallest id in
it, NULL if there is none. Repeated rows each come back. No rows give no rows. Only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from gridtally.llm.common import checkpointed
from gridtally.llm.components import components, smallest_linked

SHINGLE_WORDS = 3
MAX_BITS = 3
HASH_SEED = 42

_BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: The ten masks of two blocks, as signed longs.
MASKS = tuple(
    int(np.int64(np.uint64(sum(((1 << width) - 1) << at for at, width in pair))))
    for pair in combinations(_BLOCKS, len(_BLOCKS) - MAX_BITS)
)
#: Rows of a node that one task compares at once; larger nodes are dealt out.
NODE_ROWS = 2048
FAN_OUT = 8

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingles hashed, and pairs compared, at a time.
_CHUNK = 1 << 15
_FRONTIER = 1 << 20


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a text as a signed long."""
    # bytes.split() cuts at blanks and the controls tab to carriage return.
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    n = max(len(words) - shingle_words + 1, 1)
    starts = (ends - lengths)[:n].tolist()
    stops = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        hashes = np.array(
            [
                digest(joined[a:b], HASH_SEED)
                for a, b in zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK])
            ],
            np.uint64,
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(ones * 2 > n, bitorder="little")
    return int(packed.view(np.int64)[0])


def fingerprints(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    @F.pandas_udf(LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle_words) for t in texts], dtype="int64")

    return of(text)


def _gray_rank(code: Column) -> Column:
    """The place of a bit pattern in Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


class _Level:
    """Nodes of one level: the bits all rows below agree on, and where the children are."""

    def __init__(self, mask: np.ndarray, value: np.ndarray, first: np.ndarray, count: np.ndarray):
        self.mask, self.value, self.first, self.count = mask, value, first, count


def _levels(codes: np.ndarray, group: np.ndarray) -> list[_Level]:
    """The hierarchy over sorted codes, leaves first, up to one root per group."""
    n = len(codes)
    full = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
    levels = [_Level(full, codes, np.arange(n), np.ones(n, np.int64))]
    while True:
        below = levels[-1]
        new_group = np.r_[True, group[1:] != group[:-1]]
        if new_group.all():
            return levels
        place = np.arange(len(group))
        place -= np.maximum.accumulate(np.where(new_group, place, 0))
        first = np.flatnonzero(place % FAN_OUT == 0)
        agree = np.bitwise_and.reduceat(below.mask, first)
        ones = np.bitwise_and.reduceat(below.value | ~below.mask, first)
        zeros = np.bitwise_or.reduceat(below.value & below.mask, first)
        mask = agree & ~(ones ^ zeros)
        count = np.diff(np.r_[first, len(group)])
        levels.append(_Level(mask, ones & mask, first, count))
        group = group[first]


def _links(codes: np.ndarray, group: np.ndarray, max_bits: int) -> Iterator[tuple]:
    """Arrays of row pairs of one group that differ in at most ``max_bits`` bits."""
    levels = _levels(codes, group)
    roots = np.unique(group, return_inverse=True)[1]
    pending = [
        (len(levels) - 1, part, roots[part], np.zeros(len(part), np.int64))
        for part in np.array_split(np.arange(len(codes)), -(-len(codes) // _CHUNK))
    ]
    while pending:
        at, query, node, bits = pending.pop()
        if len(query) > _FRONTIER:
            cuts = range(0, len(query), _FRONTIER // 2)
            pending += [
                (at, *(x[c : c + _FRONTIER // 2] for x in (query, node, bits))) for c in cuts
            ]
            continue
        if at == 0:
            yield query, node
            continue
        count = levels[at].count[node]
        parent_mask = np.repeat(levels[at].mask[node], count)
        query, bits = np.repeat(query, count), np.repeat(bits, count)
        ends = np.cumsum(count)
        child = np.repeat(levels[at].first[node] - (ends - count), count) + np.arange(ends[-1])
        below = levels[at - 1]
        new = (codes[query] ^ below.value[child]) & below.mask[child] & ~parent_mask
        bits = bits + np.bitwise_count(new)
        near = bits <= max_bits
        if near.any():
            pending.append((at - 1, query[near], child[near], bits[near]))


def _search(max_bits: int):
    """Turns rows sorted by node and Gray rank into links of each row to its root."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = ["mask", "pattern", "part", "other"]
        rest = None

        def links(rows: pd.DataFrame) -> pd.DataFrame:
            group = rows.groupby(keys, sort=False).ngroup().to_numpy()
            codes = rows["code"].to_numpy()
            root = smallest_linked(len(codes), _links(codes.view(np.uint64), group, max_bits))
            moved = root != np.arange(len(root))
            return pd.DataFrame({"u": codes[moved], "v": codes[root[moved]]})

        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = (rows[keys] == rows[keys].iloc[-1]).all(axis=1).to_numpy()
            cut = int(np.argmax(last)) if len(rows) else 0
            rest = rows.iloc[cut:]
            if cut:
                yield links(rows.iloc[:cut])
        if rest is not None and len(rest):
            yield links(rest)

    return search


def link_fingerprints(codes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """A spanning forest (``u``, ``v``) of the links between the distinct longs ``code``."""
    if max_bits > MAX_BITS:
        raise ValueError(f"the nodes find at most {MAX_BITS} differing bits")
    masks = F.array(*[F.lit(m).cast("long") for m in MASKS])
    entries = codes.select("code", F.posexplode(masks).alias("mask", "bits")).select(
        "code", "mask", F.col("code").bitwiseAND(F.col("bits")).alias("pattern")
    )
    sizes = entries.groupBy("mask", "pattern").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / NODE_ROWS).cast("int")
    own = F.pmod(F.xxhash64("code"), parts).cast("int")
    # A part meets itself and every other part; one part meets itself only.
    shared = entries.join(sizes, ["mask", "pattern"]).select(
        "code", "mask", "pattern", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("partner")
    )
    dealt = shared.select(
        "mask",
        "pattern",
        F.least("own", "partner").alias("part"),
        F.greatest("own", "partner").alias("other"),
        "code",
    )
    keys = ("mask", "pattern", "part", "other")
    return (
        dealt.repartition(*keys)
        .sortWithinPartitions(*keys, _gray_rank(F.col("code")))
        .mapInPandas(_search(max_bits), "u long, v long")
    )


def _text_hash(text: Column) -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_duplicates(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """``doc_id``, ``text_hash``, ``code`` (its fingerprint), ``root`` and ``component_id``.

    One row per document; ``component_id`` is the smallest id that links reach, its own
    included, ``text_hash`` tells the texts of one id apart, and
    ``root`` is the smallest fingerprint of the group.
    """
    coded = checkpointed(
        docs.select(
            "doc_id",
            _text_hash(F.col("text")).alias("text_hash"),
            fingerprints(F.col("text"), shingle_words).alias("code"),
        )
    )
    distinct = coded.groupBy("code").agg(F.min("doc_id").alias("least_id"))
    roots = components(link_fingerprints(distinct.select("code"), max_bits))
    grouped = distinct.join(roots, F.col("code") == F.col("node"), "left").select(
        "code", "least_id", F.coalesce("root", "code").alias("root")
    )
    ids = grouped.groupBy("root").agg(F.min("least_id").alias("component_id"))
    # A text without near duplicates needs no look-up beyond its fingerprint.
    of_code = grouped.join(ids, "root").select("code", "root", "component_id")
    return coded.join(of_code, "code").select(
        "doc_id", "text_hash", "code", "root", "component_id"
    )


def representatives(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """One document of each group, with all its columns: the one with the smallest id.

    Of rows that share this id and lie in the same group, the one with the smallest text
    stays; where no row of a group has an id, the one with the smallest text.
    """
    found = near_duplicates(docs, shingle_words, max_bits)
    keeps = F.col("doc_id").eqNullSafe(F.col("component_id"))
    by_id = (
        found.groupBy("doc_id")
        .agg(F.count("*").alias("rows"), F.max(keeps).alias("keeps"))
        .where("keeps")
        .select(
            F.col("doc_id").alias("kept_id"),
            ((F.col("rows") == 1) & F.col("doc_id").isNotNull()).alias("alone"),
        )
    )
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("own_id"))
    kept = rows.join(by_id, F.col("own_id").eqNullSafe(F.col("kept_id")))
    # An id of several rows, or NULL, says nothing about a row; its text does.
    groups = found.where(keeps).select(
        F.col("doc_id").alias("group_id"), F.col("text_hash").alias("group_hash"), "root"
    )
    smallest = (
        kept.where("not alone")
        .withColumn("own_hash", _text_hash(F.col("doc.text")))
        .join(
            groups.distinct(),
            F.col("own_id").eqNullSafe(F.col("group_id"))
            & (F.col("own_hash") == F.col("group_hash")),
        )
        .groupBy("own_id", "root")
        .agg(F.min_by("doc", F.struct(F.col("doc.text"), F.xxhash64("doc"))).alias("doc"))
    )
    alone = kept.where("alone").select("doc")
    return alone.unionByName(smallest.select("doc")).select("doc.*")


def hexadecimal(code: Column) -> Column:
    return F.lower(F.lpad(F.hex(code), 16, "0"))
