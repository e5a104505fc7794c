import zlib

import numpy as np
import pytest

from gridtally.llm import toxicity
from tests.conftest import TESTDATA

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"


def _corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    plain = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(n):
        words = rng.choice(plain, rng.integers(1, 60)).tolist()
        toxic = i % 4 == 0
        if toxic:
            words += ["idiot" if i % 8 else f"scumm{i % 5}"]
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def _frames(spark, rows):
    return (
        spark.createDataFrame([(i, t) for i, t, _ in rows], DOCS),
        spark.createDataFrame([(i, 1, y) for i, _, y in rows], LABELS),
    )


def test_held_out_documents_are_told_apart(spark):
    rows = _corpus(600)
    out = {r.doc_id: r for r in toxicity.scored(*_frames(spark, rows)).collect()}
    assert len(out) == 600
    for i, _, toxic in rows:
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= out[i].score <= 1
        assert out[i].predicted == int(out[i].score >= 0.3)
    held = [(out[i].predicted, y) for i, _, y in rows if out[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.97


def test_pairs_of_terms_count():
    """Either word alone is harmless, both together are not."""
    rows, labels = [], []
    for i in range(800):
        a, b = i % 2, i // 2 % 2
        rows.append(toxicity.terms("x" + " insult" * a + " group" * b))
        labels.append(float(a and b))
    numbers = np.unique(np.concatenate(rows)).astype(np.int64)
    places = [np.flatnonzero(np.isin(numbers, row)) for row in rows]
    machine = toxicity.fit(places, np.array(labels), numbers)
    place = {int(t): p for p, t in enumerate(machine.numbers)}

    def score(text):
        return machine.score([place[t] for t in toxicity.terms(text).tolist() if t in place])

    assert score("x insult group") > 0.5 > max(score("x insult"), score("x group"), score("x"))
    assert np.abs(machine.vectors).max() > 0.1


def test_a_group_word_of_both_classes_is_learned_in_pairs(spark):
    """Half of each class has the group word; with the insult, which half has too, it is toxic."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(2400):
        toxic = i % 4 == 0
        # Of the others a half has the group word alone, a quarter the insult alone.
        extra = ["insult", "group"] if toxic else [["group"], [], ["group"], ["insult"]][i // 4 % 4]
        extra = extra if not toxic or i % 8 else ["scum"]
        words = [f"word{w}" for w in rng.choice(60, 20)] + extra
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(toxic)))
    share = [np.mean(["group" in t for _, t, y in rows if y == label]) for label in (0, 1)]
    assert share[0] == pytest.approx(share[1], abs=0.01)
    docs, labels = _frames(spark, rows)
    machine = toxicity.train(docs, labels)
    assert np.isin(toxicity.terms("group"), machine.numbers).all()
    asked = spark.createDataFrame([(1, "insult group"), (2, "insult"), (3, "group"), (4, "")], DOCS)
    scores = asked.select("doc_id", toxicity.score(asked.text, machine).alias("score"))
    both, insult, group, none = (r.score for r in sorted(scores.collect()))
    assert both >= toxicity.THRESHOLD > max(insult, group, none)
    out = toxicity.scored(docs, labels).where("held_out").collect()
    assert np.mean([r.predicted == rows[r.doc_id][2] for r in out]) > 0.97


@pytest.mark.parametrize(("plain", "longest"), [(60, 60), (1_500, 90)])
def test_a_pair_of_which_neither_word_tells_alone_is_learned(spark, plain, longest):
    """Toxic if both words are there, or the counterparts of both; each word is in half of all."""
    rng = np.random.default_rng(plain)
    rows = []
    for i in range(3_000):
        toxic = i % 4 == 0
        first = rng.random() < 0.5
        words = [f"word{w}" for w in rng.integers(0, plain, rng.integers(5, longest))]
        words += ["insult" if first else "praise", "group" if first == toxic else "crowd"]
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(toxic)))
    out = toxicity.scored(*_frames(spark, rows)).where("held_out").collect()
    assert np.mean([r.predicted == rows[r.doc_id][2] for r in out]) > 0.95


def test_score_is_the_sum_over_all_pairs(spark):
    """The closed form of the machine against a loop over all pairs of a text's terms."""
    machine = toxicity.train(*_frames(spark, _corpus(400)))
    assert len(machine.numbers) > 50 and machine.vectors.shape[1] == 2 * toxicity.RANK
    texts = ["idiot word1 word2", "word3", "", "scumm1 idiots word9 word9 unheard"]
    asked = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r[0]: r[1] for r in asked.select("doc_id", toxicity.score(asked.text, machine)).collect()}
    for i, text in enumerate(texts):
        places = np.flatnonzero(np.isin(machine.numbers, toxicity.terms(text)))
        z = machine.intercept + sum(float(machine.weights[p]) for p in places)
        for a, p in enumerate(places):
            for q in places[a + 1 :]:
                z += sum(float(x) * float(y) for x, y in zip(machine.vectors[p], machine.vectors[q]))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_sample_is_bounded_in_terms(spark, monkeypatch):
    rows = _corpus(400)
    monkeypatch.setattr(toxicity, "SAMPLE_TERMS", 5_000)
    seen = []
    fitted = toxicity._fitted
    monkeypatch.setattr(toxicity, "_fitted", lambda r, y, t: seen.append(sum(map(len, r))) or fitted(r, y, t))
    toxicity.train(*_frames(spark, rows))
    assert 4_000 < seen[0] <= 5_000


def test_held_out_labels_are_not_read(spark):
    rows = _corpus(200)
    docs, labels = _frames(spark, rows)
    turned = [(i, 1, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in rows]
    again = toxicity.scored(docs, spark.createDataFrame(turned, LABELS))
    first = sorted(map(tuple, toxicity.scored(docs, labels).collect()))
    assert first == sorted(map(tuple, again.collect()))


def test_edges(spark):
    rows = _corpus(80)
    docs, labels = _frames(spark, rows)
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "idiot " * 20_000), (2, "x😀")], DOCS)
    noise = spark.createDataFrame([(None, 1, 1), (5, 1, None), (10**9, 0, 1), (0, 1, 0)], LABELS)
    both = docs.unionByName(odd).selectExpr("*", "1 as score", "'a' as toxic")
    out = toxicity.scored(both, labels.unionByName(noise))
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    assert out.where("score between 0 and 1").count() == 84
    alone = toxicity.scored(docs, labels.limit(0))
    assert {(r.predicted, round(r.score, 6)) for r in alone.collect()} == {(0, 0.0)}
    assert toxicity.scored(docs.limit(0), labels).collect() == []


@pytest.mark.parametrize("scale", ["sf0.1"])
def test_given_labels(spark, scale):
    docs = spark.read.parquet(f"{TESTDATA}/{scale}/documents.parquet")
    labels = spark.read.parquet(f"{TESTDATA}/{scale}/labels.parquet")
    out = toxicity.scored(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    caught = out[out.toxic == 1].predicted.mean()
    wrong = out[out.toxic == 0].predicted.mean()
    assert caught > 0.85
    assert wrong < 0.01
