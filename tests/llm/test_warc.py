import base64
import gzip
import hashlib
import io
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridtally.llm import warc, warc_archive
from gridtally.llm.warc_archive import Settings, read_archive, write_archive

SCHEMA = "page_id long, url string, html string, shard string, payload string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "s", "p") for r in rows], SCHEMA)


def written(spark, tmp_path, rows, name="a", settings=Settings(), partitions=3):
    folder = f"file://{tmp_path}/{name}"
    listed = write_archive(table(spark, rows).repartition(partitions), folder, settings)
    return folder, listed


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def brute(rows, min_bytes=0):
    """Each row's result; among equal payloads the largest page id, once, is the response."""
    best, out = {}, Counter()
    for page_id, url, html in rows:
        payload = (html or "").encode()
        rank = (page_id is not None, page_id or 0)
        best[payload] = max(best.get(payload, rank), rank)
    taken = set()
    for page_id, url, html in rows:
        payload = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        rank = (page_id is not None, page_id or 0)
        first = rank == best[payload] and payload not in taken
        if first or len(payload) < min_bytes:
            taken.add(payload)
            out[(page_id, len(payload), digest, "response", None)] += 1
        else:
            refers = best[payload][1] if best[payload][0] else None
            out[(page_id, len(payload), digest, "revisit", refers)] += 1
    return out


def found(frame):
    return Counter(tuple(r) for r in frame.select(*COLUMNS).collect())


ROWS = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>two</p>"), (3, "http://a/3", "<p>one</p>"),
    (4, None, "nul\0l é𝄞 \r\n\r\nWARC/1.1\r\n"), (None, "http://a/none", "<p>one</p>"), (5, "http://a/\r\nX: y ü", None),
    (6, "http://a/6", ""), (None, None, None), (None, None, "only here"), (None, "x", "only here"),
    (-7, "http://a/-7", "long " * 200_000), (8, "http://a/8", "<p>8</p>"), (8, "http://a/8", "<p>8</p>"),
    (8, "http://a/other", "<p>8</p>"), (8, "http://a/8", "<p>eight</p>"), (2**62, "u", "<p>two</p>"),
    *[(9, "http://hot", "the same row")] * 2_500, *[(i, "http://h", "the same payload") for i in range(100, 1_100)],
]


def test_round_trip(spark, tmp_path):
    settings = Settings(shard_bytes=100_000, roll_bytes=20_000)
    folder, listed = written(spark, tmp_path, ROWS, settings=settings)
    read = read_archive(spark, folder, payloads=True)
    assert found(read) == brute(ROWS)
    texts = read.where("record_type = 'response'").select("payload").collect()
    assert {bytes(r[0]).decode() for r in texts} == {html or "" for _, _, html in ROWS}
    files = listed.collect()
    assert len({f["shard"] for f in files}) > 5 and len(files) > len({f["shard"] for f in files})
    assert sum(f["records"] for f in files) == len(ROWS)
    ids = [r[0] for r in read.select("record_id").collect()]
    assert len(ids) == len(set(ids))
    responses = {r[0]: r[1] for r in read.where("record_type = 'response'").select("record_id", "page_id").collect()}
    for row in read.where("record_type = 'revisit'").select("refers_to_id", "refers_to").collect():
        assert responses[row["refers_to_id"]] == row["refers_to"]


def test_files_are_the_same_however_the_table_lies(spark, tmp_path):
    settings = Settings(shard_bytes=50_000)
    one = written(spark, tmp_path, ROWS, "one", settings, partitions=1)[1]
    spark.conf.set("spark.sql.shuffle.partitions", 3)
    try:
        other = written(spark, tmp_path, ROWS[::-1], "other", settings, partitions=7)[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert sorted(one.collect()) == sorted(other.collect())
    for name in [r["name"] for r in one.collect()]:
        a, b = ((tmp_path / d / name).read_bytes() for d in ("one", "other"))
        assert a == b
    again = sorted(hashlib.sha256((tmp_path / "one" / r["name"]).read_bytes()).hexdigest() for r in one.collect())
    assert again == sorted(r["sha256"] for r in one.collect())


def test_records_are_in_page_order(spark, tmp_path):
    folder, listed = written(spark, tmp_path, ROWS, settings=Settings(shard_bytes=50_000))
    ids = []
    for name in sorted(r["name"] for r in listed.collect()):
        with gzip.open(tmp_path / "a" / name) as stream:
            for record in warc.records(stream):
                if record.kind != warc.INFO:
                    ids.append(record.fields.get(warc.PAGE_FIELD.lower()))
    numbers = [(i is not None, int(i or 0)) for i in ids]
    assert numbers == sorted(numbers) and len(numbers) == len(ROWS)


def test_each_record_is_a_member(spark, tmp_path):
    folder, listed = written(spark, tmp_path, ROWS[:6])
    (only,) = listed.collect()
    data = (tmp_path / "a" / only["name"]).read_bytes()
    assert data.count(b"\x1f\x8b\x08") == 1 + 6
    assert len(data) == only["bytes"]


def test_small_payloads_are_never_revisits(spark, tmp_path):
    rows = [(i, "u", "tiny" if i % 2 else "not so tiny") for i in range(10)] + [(3, "u", "tiny")] * 3
    folder, _ = written(spark, tmp_path, rows, settings=Settings(min_bytes=6))
    assert found(read_archive(spark, folder)) == brute(rows, min_bytes=6)


def test_empty_table(spark, tmp_path):
    folder, listed = written(spark, tmp_path, [])
    assert listed.count() == 0
    assert read_archive(spark, folder).collect() == []


def test_files_that_are_not_in_the_manifest_do_not_count(spark, tmp_path):
    folder, _ = written(spark, tmp_path, ROWS[:5])
    (tmp_path / "a" / "pages-000009-0000.warc.gz").write_bytes(b"left by a lost attempt")
    assert found(read_archive(spark, folder)) == brute(ROWS[:5])
    assert not (tmp_path / "a" / "_temporary").exists()


def test_commit_again(spark, tmp_path):
    folder, listed = written(spark, tmp_path, ROWS[:5])
    again = listed.withColumn("temporary", F.lit("_temporary/gone")).select(
        *[c.split()[0] for c in warc_archive._WRITTEN.split(", ")]
    )
    commit = warc_archive._committer(folder)
    moved = again.mapInArrow(commit, warc_archive._WRITTEN.replace("temporary string, ", ""))
    assert moved.count() == 1
    (only,) = listed.collect()
    os.truncate(tmp_path / "a" / only["name"], 10)
    with pytest.raises(Exception, match="has not the size"):
        again.mapInArrow(commit, warc_archive._WRITTEN.replace("temporary string, ", "")).count()


def test_broken_bytes():
    good = warc.record({"WARC-Type": "response", "WARC-Record-ID": "<x>"}, b"block")
    assert [r.block for r in warc.records(io.BytesIO(good * 2))] == [b"block", b"block"]
    for bad in (good.replace(b"block", b"black"), good[:-6], b"junk\r\n" + good):
        with pytest.raises(warc.BrokenArchive):
            list(warc.records(io.BytesIO(bad)))


def test_payload_that_does_not_arrive():
    row = {"key": "k", "start": 0, "n": 1, "responses": 1, "small": None, "shard": 0, "page_id": 1, "url": "u",
           "digest": "00" * 20, "size": 1, "kept_key": "k", "kept_page_id": 1, "kept_url": "u"}
    with pytest.raises(warc.BrokenArchive):
        list(warc_archive._records(iter([row]), "d"))
