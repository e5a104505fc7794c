"""The pipeline's stages, one after the other, against what each must keep."""

import re

import pytest

import corpus_pipeline
from gridtally.llm import packing, toxicity
from tests.conftest import TESTDATA
from tests.llm.test_pii import _base
from tests.llm.test_simhash import _groups, _plain, _signed

FOLDER = f"{TESTDATA}/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that each stage gets and, last, what the pipeline returns."""
    out = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    frames = [docs]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], FOLDER).write.parquet(f"{out}/{n}")
        frames.append(spark.read.parquet(f"{out}/{n}"))
    return dict(zip([name for name, _ in corpus_pipeline.STAGES] + ["result"], frames))


def _texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_order_and_columns(stages):
    assert list(stages) == ["toxicity", "simhash", "pii", "mixing", "packing", "result"]
    assert all(stages[name].columns == COLUMNS for name in list(stages)[:-1])


def test_toxic_documents_go(spark, stages):
    docs = stages["toxicity"]
    scores = toxicity.scored(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")).collect()
    keep = {r.doc_id for r in scores if not r.predicted}
    assert 0 < len(keep) < docs.count()
    assert set(_texts(stages["simhash"])) == keep


def test_one_document_of_each_group_stays(stages):
    texts = _texts(stages["simhash"])
    codes = {i: _signed(_plain(t)) for i, t in texts.items()}
    roots = _groups(codes.values())
    least = {}
    for i, code in codes.items():
        root = roots[code]
        least[root] = min(i, least.get(root, i))
    assert set(_texts(stages["pii"])) == set(least.values())


def test_personal_data_goes_and_the_rest_stays(stages):
    before, after = _texts(stages["pii"]), _texts(stages["mixing"])
    assert set(before) == set(after)
    assert any(_base(t) for t in before.values())
    for i, text in before.items():
        assert _base(after[i]) == []
        if not re.search(r"[0-9@]", text):
            assert after[i] == text


def test_mix_repeats_and_drops_whole_documents(stages):
    before = _texts(stages["mixing"])
    counts = {}
    for r in stages["packing"].collect():
        assert r.text == before[r.doc_id]
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert max(counts.values()) <= 2
    total = sum(len(t.split()) for t in before.values())
    mixed = sum(n * len(before[i].split()) for i, n in counts.items())
    assert mixed == pytest.approx(1.5 * total, rel=0.03)


def test_sequences_hold_every_word(stages):
    documents = stages["packing"].collect()
    bins = stages["result"].collect()
    assert sum(b.words for b in bins) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in documents)
    assert {i for b in bins for i in b.doc_ids} == {r.doc_id for r in documents if r.text.split()}
    assert all(b.words <= b.length in packing.LENGTHS for b in bins)


def test_run_gives_the_same_documents(spark, stages):
    bins = corpus_pipeline.run(spark, FOLDER).collect()
    ids = sorted(i for b in bins for i in b.doc_ids)
    assert ids == sorted(i for b in stages["result"].collect() for i in b.doc_ids)


def test_each_stage_is_computed_once(spark, monkeypatch):
    """No stage reads what the one before it returns more often than a handful of times."""
    read = [spark.sparkContext.accumulator(0) for _ in corpus_pipeline.STAGES]
    sizes = []

    def counting(at, stage):
        def rows(batches):
            for batch in batches:
                read[at].add(len(batch))
                yield batch

        def counted(spark, docs, sf_dir):
            sizes.append(docs.count())
            return stage(spark, docs.mapInPandas(rows, docs.schema), sf_dir)

        return counted

    stages = [(name, counting(at, stage)) for at, (name, stage) in enumerate(corpus_pipeline.STAGES)]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    for (name, _), seen, size in zip(stages, read, sizes):
        assert size <= seen.value <= 4 * size, name


def test_odd_rows_pass_every_stage(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string, row int"
    rows = [
        (1, None, None, None, None, "x", 1), (1, None, None, None, None, "x", 1),
        (None, "a b c d", "en", "s", 7, None, None), (2, "", "en", "s", 0, "y", 2),
        (3, "word " * 30_000, "en", "s", 150_000, "y", 2), (4, "mail a@b.co now", "de", None, 15, "", 0),
    ]
    for n, data in enumerate((rows, [])):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert out.columns == docs.columns
                out.write.parquet(f"{tmp_path}/{n}{name}")
                docs = spark.read.parquet(f"{tmp_path}/{n}{name}")
        assert sum(b.words for b in out.collect()) >= (30_000 if n == 0 else 0)
