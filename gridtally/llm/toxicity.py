"""Toxicity scores from a factorization machine over hashed terms.

The terms of a text are its distinct words and their first letters, so that inflected and
made-up forms of a word share a term; every term is hashed to ``TERM_BITS`` bits. The
machine has a weight for each telling term, whose frequencies differ between toxic and
other documents, and a vector for every term of the sample that is seen twice. The inner
products of vectors weigh pairs of terms: two terms that are harmless alone can be an
insult together, and neither has to tell anything by itself.

Learning goes in two steps. The first fits weights, and vectors, of the telling terms. The
second fits further components of all vectors to what the first left unexplained; a part
of the sample is kept apart to say how long that helps, and whether it does at all.

The sample is bounded: of each class the ``CLASS_ROWS`` labelled documents that come first
in a pseudo-random order of their ids, and of these as many as have ``SAMPLE_TERMS`` terms
in all. Spark counts their terms; the numbers of the terms of each document come to the
driver, partition by partition. All documents are scored, whole, where they lie; nothing
is shuffled.

Cases: a NULL text is empty; a text without known terms has the score of the intercept.
A document id with several labels is toxic if one of them says so; NULL labels and labels
without documents are left out; of documents with one id one text is learned from.
Without labels of both classes the score is 0 everywhere. Ids of NULL count as empty
strings in the held-out rule. Repeated rows are scored alike. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gridtally.llm.common import checkpointed

THRESHOLD = 0.3
#: Lengths of word beginnings that are terms.
PREFIXES = (3, 4, 5)
TERM_BITS = 22
#: Documents learned from, at most, of the toxic and of the other labelled ones, and the
#: terms that all of them may have together (four bytes each on the driver).
CLASS_ROWS = {1: 6_000, 0: 12_000}
SAMPLE_TERMS = 12_000_000
#: Terms in fewer documents of the sample, or whose frequencies in the two classes differ
#: by less than this log-likelihood ratio, have no weight of their own; so many at most do.
MIN_DOCUMENTS, MIN_RATIO, MAX_TERMS = 3, 15.0, 20_000
#: What part of the sample toxic documents weigh, whatever their number.
TOXIC_SHARE = 0.2
RANK = 4
EPOCHS, BATCH, RATE = 12, 64, 0.2
#: How fast weights and vectors shrink.
WEIGHT_PENALTY, VECTOR_PENALTY = 1e-4, 1e-3
#: The second step: rounds at most and without progress, the share of a document's terms
#: that a round sees, the part of the sample kept apart, and the size of steps and starts.
PAIR_EPOCHS, PATIENCE, SEEN_SHARE, CHECK_SHARE = 15, 3, 0.7, 0.2
PAIR_PENALTY, PAIR_RATE, PAIR_START = 1e-2, 0.05, 0.05
SEED = 5

_WORD = re.compile(r"[^\W_]+")
#: Words whose terms a task keeps at hand.
_KEPT_WORDS = 200_000


def _word_terms(word: str) -> list[int]:
    parts = [f"={word}", *[f"^{word[:n]}" for n in PREFIXES if len(word) >= n]]
    return [zlib.crc32(part.encode("utf-8", "replace")) >> (32 - TERM_BITS) for part in parts]


def terms(text: str | None) -> np.ndarray:
    """The distinct term numbers of a text, ascending."""
    words = set(_WORD.findall((text or "").lower()))
    return np.unique(np.array([t for w in words for t in _word_terms(w)], np.int32))


@dataclass
class Machine:
    """``numbers`` are the known terms, ascending; weights and vectors are in their order."""

    numbers: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray
    intercept: float

    def score(self, places: Sequence[int]) -> float:
        """The probability for a text with the terms at these places."""
        return float(_probability(_sum(self, places)))


def _probability(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


NOTHING = Machine(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, RANK)), -30.0)


def _class_weights(labels: np.ndarray) -> np.ndarray:
    """Of each document; toxic ones together have ``TOXIC_SHARE`` of all."""
    toxic = labels.mean()
    return np.where(labels > 0, TOXIC_SHARE / toxic, (1 - TOXIC_SHARE) / (1 - toxic))


def fit(rows: list[np.ndarray], labels: np.ndarray, numbers: np.ndarray) -> Machine:
    """Learns by stochastic gradients with a step size of its own for each weight.

    ``numbers`` are the terms to learn, ascending; a row has the places of its terms there.
    """
    if len(set(labels.tolist())) < 2:
        return NOTHING
    n = len(numbers)
    rng = np.random.default_rng(SEED)
    weight = _class_weights(labels)
    intercept = float(np.log(TOXIC_SHARE / (1 - TOXIC_SHARE)))
    w, w_seen = np.zeros(n), np.full(n, 1e-6)
    v, v_seen = rng.normal(0, 0.01, (n, RANK)), np.full((n, RANK), 1e-6)
    intercept_seen = 1e-6
    for _ in range(EPOCHS if any(map(len, rows)) else 0):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            batch = order[start : start + BATCH]
            doc = np.repeat(np.arange(len(batch)), [len(rows[i]) for i in batch])
            used, at = np.unique(np.concatenate([rows[i] for i in batch]), return_inverse=True)
            own_w, own_v = w[used], v[used]
            of_term = own_v[at]
            sums, pairs = _pairs(of_term, doc, len(batch))
            z = intercept + np.bincount(doc, own_w[at], len(batch)) + pairs
            error = (_probability(z) - labels[batch]) * weight[batch] / len(batch)
            per_term = error[doc]
            grad = np.bincount(at, per_term, len(used)) + WEIGHT_PENALTY * own_w
            w_seen[used] += grad**2
            w[used] = own_w - RATE * grad / np.sqrt(w_seen[used])
            grads = _gradients(per_term, sums[doc] - of_term, at, len(used))
            grads = grads + VECTOR_PENALTY * own_v
            v_seen[used] += grads**2
            v[used] = own_v - RATE / 4 * grads / np.sqrt(v_seen[used])
            slope = float(error.sum())
            intercept_seen += slope**2
            intercept -= RATE * slope / intercept_seen**0.5
    return Machine(numbers, w, v, intercept)


def _pairs(of_term: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of vectors and sums of inner products of all pairs of terms, for each document."""
    rank = of_term.shape[1]
    sums = np.stack([np.bincount(doc, of_term[:, f], n) for f in range(rank)], axis=1)
    squares = np.bincount(doc, (of_term**2).sum(axis=1), n)
    return sums, ((sums**2).sum(axis=1) - squares) / 2


def _gradients(per_term: np.ndarray, others: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Of the vectors: the error times the sum of the other vectors in the document."""
    pull = per_term[:, None] * others
    return np.stack([np.bincount(at, pull[:, f], n) for f in range(pull.shape[1])], axis=1)


def fit_pairs(
    rows: list[np.ndarray], labels: np.ndarray, known: np.ndarray, n_terms: int
) -> tuple[np.ndarray, float]:
    """Vectors of all terms for what ``known``, the sum of the first step, leaves unexplained.

    A row has the places of a document's terms. Returns the vectors, and what they add to
    the intercept, of the round that explains the documents kept apart best; zeros if none
    explains them better than ``known`` does.
    """
    rng = np.random.default_rng(SEED)
    weight = _class_weights(labels)
    apart = rng.random(len(rows)) < CHECK_SHARE
    learned, checked = np.flatnonzero(~apart), np.flatnonzero(apart)
    v = rng.normal(0, PAIR_START, (n_terms, RANK)).astype(np.float32)
    v_seen = np.full((n_terms, RANK), 1e-6, np.float32)
    shift, shift_seen = 0.0, 1e-6

    def pairs_of(docs: np.ndarray) -> np.ndarray:
        out = []
        for start in range(0, len(docs), BATCH):
            batch = [rows[i] for i in docs[start : start + BATCH]]
            doc = np.repeat(np.arange(len(batch)), list(map(len, batch)))
            out.append(_pairs(v[np.concatenate(batch)].astype(np.float64), doc, len(batch))[1])
        return np.concatenate(out) if out else np.zeros(0)

    def loss(z: np.ndarray) -> float:
        p = np.clip(_probability(z), 1e-12, 1 - 1e-12)
        right = np.where(labels[checked] > 0, p, 1 - p)
        return float(-(weight[checked] * np.log(right)).sum() / max(weight[checked].sum(), 1e-12))

    least, best, stale = loss(known[checked]), (np.zeros_like(v), 0.0), 0
    for _ in range(PAIR_EPOCHS):
        order = rng.permutation(learned)
        for start in range(0, len(order), BATCH):
            batch = order[start : start + BATCH]
            seen = [rows[i][rng.random(len(rows[i])) < SEEN_SHARE] for i in batch]
            doc = np.repeat(np.arange(len(batch)), list(map(len, seen)))
            used, at = np.unique(np.concatenate(seen), return_inverse=True)
            own = v[used].astype(np.float64)
            of_term = own[at]
            sums, pairs = _pairs(of_term, doc, len(batch))
            error = _probability(known[batch] + shift + pairs) - labels[batch]
            error *= weight[batch] / len(batch)
            grads = _gradients(error[doc], sums[doc] - of_term, at, len(used)) + PAIR_PENALTY * own
            v_seen[used] += grads**2
            v[used] = own - PAIR_RATE * grads / np.sqrt(v_seen[used])
            slope = float(error.sum())
            shift_seen += slope**2
            shift -= RATE * slope / shift_seen**0.5
        # As learned, and as strong as among the terms that a round sees.
        whole = pairs_of(checked)
        now, share = min((loss(known[checked] + shift + a * whole), a) for a in (1.0, SEEN_SHARE**2))
        stale += 1
        if now < least:
            least, best, stale = now, (v * np.float32(share**0.5), shift), 0
        if stale == PATIENCE:
            break
    return best


def held_out(doc_id: Column) -> Column:
    """Whether labels of this document must not be learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def _telling(learned: DataFrame) -> np.ndarray:
    """The terms, ascending, whose frequencies tell the two classes apart."""
    n = {r.toxic: r.rows for r in learned.groupBy("toxic").agg(F.count("*").alias("rows")).collect()}
    if len(n) < 2:
        return np.zeros(0, np.int64)
    share = F.col("seen") / float(n[0] + n[1])

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(0.0)

    ratio = F.lit(0.0)
    for seen, rows in ((F.col("toxic"), n[1]), (F.col("seen") - F.col("toxic"), n[0])):
        ratio += 2 * part(seen, share * rows) + 2 * part(rows - seen, (1 - share) * rows)
    told = (
        learned.select("toxic", F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.count("*").alias("seen"))
        .where(F.col("seen") >= MIN_DOCUMENTS)
        .withColumn("ratio", ratio)
        .where(F.col("ratio") >= MIN_RATIO)
        .orderBy(F.desc("ratio"), "term")
        .limit(MAX_TERMS)
    )
    return np.array(sorted(r.term for r in told.collect()), np.int64)


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """A machine fitted on the sample; ``labels`` has ``doc_id`` and ``toxic``."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .withColumn("place", F.xxhash64(F.lit(SEED), "doc_id"))
    )
    parts = [
        known.where(F.col("toxic") == label).orderBy("place", "doc_id").limit(rows)
        for label, rows in CLASS_ROWS.items()
    ]
    sample = F.broadcast(parts[0].unionByName(parts[1]))

    def with_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns="text").assign(terms=[terms(t) for t in batch["text"]])

    learned = checkpointed(
        docs.select("doc_id", "text")
        .join(sample, "doc_id")
        .mapInPandas(with_terms, "doc_id long, toxic int, place long, terms array<int>")
        .groupBy("doc_id", "toxic", "place")
        .agg(F.min("terms").alias("terms"))
    )
    learned = learned.where(F.col("place") <= F.lit(_last_place(learned)))
    telling = _telling(learned)
    rows, toxic = _collected(learned)
    return _fitted(rows, toxic, telling)


def _last_place(learned: DataFrame) -> int:
    """Where in the order of the sample ``SAMPLE_TERMS`` terms are passed."""
    sizes = learned.select("place", F.size("terms").alias("terms")).collect()
    total = 0
    for row in sorted(sizes):
        total += row["terms"]
        if total > SAMPLE_TERMS:
            return row["place"] - 1
    return (1 << 63) - 1


def _collected(learned: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """The term numbers of each document, in order of ids, and which documents are toxic."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            numbers = [np.asarray(t, np.int32).tobytes() for t in batch["terms"]]
            yield batch[["doc_id", "toxic"]].assign(terms=numbers)

    # As bytes, and partition by partition: lists would take the driver many times the memory.
    rows = learned.mapInPandas(packed, "doc_id long, toxic int, terms binary").toLocalIterator()
    held = sorted(
        ((r["doc_id"], r["toxic"], np.frombuffer(bytes(r["terms"]), np.int32)) for r in rows),
        key=lambda row: row[0],
    )
    return [t for _, _, t in held], np.array([y for _, y, _ in held], np.float64)


def _fitted(rows: list[np.ndarray], labels: np.ndarray, telling: np.ndarray) -> Machine:
    """Both steps; ``rows`` are term numbers, each replaced by its places on the way."""
    if len(set(labels.tolist())) < 2:
        return NOTHING
    first = fit([np.searchsorted(telling, _common(r, telling)) for r in rows], labels, telling)

    seen = np.zeros(1 << TERM_BITS, np.int32)
    for row in rows:
        seen[row] += 1
    numbers = np.union1d(np.flatnonzero(seen >= 2), telling)
    place = np.full(1 << TERM_BITS, -1, np.int32)
    place[numbers] = np.arange(len(numbers))
    for i, row in enumerate(rows):
        found = place[row]
        rows[i] = found[found >= 0]
    del seen
    weights, vectors = np.zeros(len(numbers), np.float32), np.zeros((len(numbers), 2 * RANK), np.float32)
    weights[place[telling]], vectors[place[telling], :RANK] = first.weights, first.vectors
    known = Machine(numbers, weights, vectors, first.intercept)
    sums = np.array([_sum(known, row) for row in rows])
    vectors[:, RANK:], shift = fit_pairs(rows, labels, sums, len(numbers))
    used = (weights != 0) | (vectors != 0).any(axis=1)
    return Machine(numbers[used], weights[used], vectors[used], first.intercept + shift)


def _common(row: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    return row[np.isin(row, numbers)]


def _sum(machine: Machine, places: Sequence[int]) -> float:
    """The sum of weights and pairs, before it becomes a probability."""
    v = machine.vectors[places].astype(np.float64)
    pairs = ((v.sum(axis=0) ** 2) - (v**2).sum(axis=0)).sum() / 2
    return float(machine.intercept + machine.weights[places].astype(np.float64).sum() + pairs)


def score(text: Column, machine: Machine) -> Column:
    """The score of each text, between 0 and 1."""

    @F.pandas_udf(DoubleType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        place = dict(zip(machine.numbers.tolist(), range(len(machine.numbers))))
        known: dict[str, list[int]] = {}

        def places_of(word: str) -> list[int]:
            found = known.get(word)
            if found is None:
                if len(known) >= _KEPT_WORDS:
                    known.clear()
                found = known[word] = [place[t] for t in _word_terms(word) if t in place]
            return found

        def one(text: str | None) -> float:
            words = set(_WORD.findall((text or "").lower()))
            found: set[int] = set().union(*map(places_of, words))
            places = np.fromiter(found, np.int32, len(found))
            places.sort()
            return float(_probability(_sum(machine, places)))

        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype="float64")

    return of(text)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for each document."""
    machine = train(docs, labels)
    return docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), machine).alias("score")
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
