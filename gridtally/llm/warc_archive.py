"""Page tables as folders of WARC files, written the same way every time.

1. **Plan.** A scan that keeps no payload numbers the copies of identical rows, finds the
   page that stands for each payload, and cuts the records, in key order, into shards of
   equal size. Shards follow from the data alone, not from its partitions.
2. **Deal.** Payloads are dealt out to the shards by their keys, together with the plan's
   rows, and sorted: each shard is one sorted stream in which a plan row precedes the
   payload it wants. This is the only exchange of payloads.
3. **Write.** A task streams its shards into files under temporary names, a gzip member for
   each record, and begins a new file when the compressed size is reached. It returns what
   it wrote; only that is committed, so files of lost attempts count for nothing.
4. **Commit.** Files are moved to their final names, which may be repeated, and then listed
   in the manifest. Readers open what the manifest lists, and nothing else.

Files are reached through ``pyarrow.fs``: local and shared disks, HDFS, S3 and GCS.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridtally.llm import warc
from gridtally.llm.common import checkpointed

#: Bytes of payload and headers in a shard, where that makes no more than ``MAX_SHARDS``.
SHARD_BYTES = 16 << 20
#: Bounds what the driver holds and sends out: a key of about 100 bytes for each shard.
MAX_SHARDS = 20_000
#: Compressed bytes from which a file is followed by another.
ROLL_BYTES = 256 << 20
#: Header bytes a record counts with.
RECORD_BYTES = 700
#: Copies of one row that are planned, and written, together.
COPIES_PER_BLOCK = 1_000

_MANIFEST, _TEMPORARY = "manifest", "_temporary"


@dataclass(frozen=True)
class Settings:
    """``date`` is the time of all records: the table has none, and reruns must agree.

    Payloads of fewer than ``min_bytes`` are never replaced by revisits.
    """

    date: str = "2000-01-01T00:00:00Z"
    min_bytes: int = 0
    level: int = 6
    shard_bytes: int = SHARD_BYTES
    roll_bytes: int = ROLL_BYTES


def _filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and path of a URI as Spark writes it."""
    uri = re.sub("^file:/+", "file:///", re.sub("^s3[an]:", "s3:", uri))
    return pa.fs.FileSystem.from_uri(uri)


# -- plan --------------------------------------------------------------------------


def _keyed(pages: DataFrame) -> DataFrame:
    """``key, page_id, url, payload, content``; keys sort by page id, NULL first.

    Rows have the same key only if they are identical.
    """
    page_id = F.col("page_id").cast("long")
    # With the sign bit turned, the hexadecimal digits sort as the numbers do.
    digits = F.lpad(F.hex(page_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    order = F.coalesce(F.concat(F.lit("1"), digits), F.lit("0"))
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    content = F.sha2(payload, 256)
    url = F.coalesce(F.concat(F.lit("="), F.col("url")), F.lit(""))
    key = F.concat_ws(":", order, F.sha2(F.concat(content, url), 256))
    return pages.select(
        key.alias("key"),
        page_id.alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
        content.alias("content"),
    )


def _blocks(keyed: DataFrame, min_bytes: int) -> DataFrame:
    """Up to ``COPIES_PER_BLOCK`` copies of one row each, with the page they refer to.

    ``responses`` tells how many of the copies carry the payload: the first copy of the
    largest key among equal payloads, or all copies of a small payload, which then travels
    in ``small``.
    """
    size = F.octet_length("payload")
    narrow = keyed.select(
        "key",
        "page_id",
        "url",
        "content",
        F.sha1("payload").alias("digest"),
        size.cast("long").alias("size"),
        F.when(size < min_bytes, F.col("payload")).alias("small"),
    )
    counted = checkpointed(
        narrow.groupBy("key", "page_id", "url", "content", "digest", "size", "small").agg(
            F.count(F.lit(1)).alias("copies")
        )
    )
    largest = F.max(F.struct("key", "page_id", "url"))
    kept = counted.groupBy("content").agg(largest.alias("kept"))
    starts = F.sequence(
        F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES_PER_BLOCK).cast("long")
    )
    blocks = counted.join(kept, "content").withColumn("start", F.explode(starts))
    first = (F.col("key") == F.col("kept.key")) & (F.col("start") == 0)
    n = F.least(F.col("copies") - F.col("start"), F.lit(COPIES_PER_BLOCK)).cast("long")
    return blocks.select(
        "key",
        "start",
        n.alias("n"),
        F.when(F.col("small").isNotNull(), n).otherwise(first.cast("long")).alias("responses"),
        "page_id",
        "url",
        "digest",
        "size",
        "small",
        F.col("kept.key").alias("kept_key"),
        F.col("kept.page_id").alias("kept_page_id"),
        F.col("kept.url").alias("kept_url"),
    )


def _sharded(blocks: DataFrame, shard_bytes: int) -> DataFrame:
    """The blocks with ``shard``: by the bytes before them in the order of all keys.

    Sums run inside the ranges of a range partitioning and over its ranges, so no task
    sees all rows; wherever the ranges end, the sums are the same.
    """
    cost = F.col("n") * RECORD_BYTES + F.col("responses") * F.col("size")
    ranged = blocks.repartitionByRange("key", "start").select(
        "*", cost.alias("cost"), F.spark_partition_id().alias("range")
    )
    ranged = checkpointed(ranged)
    ranges = checkpointed(ranged.groupBy("range").agg(F.sum("cost").alias("range_cost")))
    # One row for each partition.
    in_order = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(
        "range", F.coalesce(F.sum("range_cost").over(in_order), F.lit(0)).alias("offset")
    )
    total = ranges.agg(F.sum("range_cost")).first()[0] or 0
    wanted = max(shard_bytes, -(-total // MAX_SHARDS))
    inside = (
        Window.partitionBy("range").orderBy("key", "start").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.sum("cost").over(inside), F.lit(0)) + F.col("offset")
    placed = ranged.join(F.broadcast(offsets), "range").withColumn(
        "shard", F.floor(before / F.lit(wanted)).cast("int")
    )
    return checkpointed(placed.drop("range", "cost", "offset"))


# -- deal --------------------------------------------------------------------------

_REMEMBERED = 100_000


def _dealt(firsts: list[tuple[str, int]], shards: list[int]):
    """Payloads with the shard of their key. A task sends copies of a row on once."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            keys = batch.column("key").to_pylist()
            rows, at = [], []
            for row, key in enumerate(keys):
                if key in seen:
                    continue
                if len(seen) >= _REMEMBERED:  # what is sent twice is left out by the writer
                    seen.clear()
                seen.add(key)
                rows.append(row)
                at.append(shards[bisect.bisect_right(firsts, (key, 0)) - 1])
            taken = batch.take(pa.array(rows, pa.int64()))
            columns = [pa.array(at, pa.int32()), taken.column("key"), taken.column("payload")]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "key", "payload"])

    return deal


# -- write -------------------------------------------------------------------------

_WRITTEN = "shard int, number int, name string, temporary string, records long, bytes long, sha256 string"


class _Shard:
    """The files of one shard, written one after the other."""

    def __init__(self, folder: str, settings: Settings, shard: int) -> None:
        self.files, self.root = _filesystem(folder)
        self.settings, self.shard = settings, shard
        self.number, self.stream, self.written = 0, None, []

    def add(self, record: bytes) -> None:
        if self.stream is None:
            self._open()
        self._put(record)
        self.records += 1
        if self.bytes >= self.settings.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None
            self.written.append(
                (self.shard, self.number, self.name, self.temporary, self.records, self.bytes, self.sha.hexdigest())
            )
            self.number += 1

    def _open(self) -> None:
        self.name = f"pages-{self.shard:06d}-{self.number:04d}.warc.gz"
        self.temporary = f"{_TEMPORARY}/{uuid.uuid4().hex}"
        self.files.create_dir(posixpath.join(self.root, _TEMPORARY), recursive=True)
        path = posixpath.join(self.root, self.temporary)
        self.stream = self.files.open_output_stream(path, compression=None)
        self.records, self.bytes, self.sha = 0, 0, hashlib.sha256()
        fields = {
            "WARC-Type": warc.INFO,
            "WARC-Date": self.settings.date,
            "WARC-Record-ID": warc.record_id(self.name),
            "WARC-Filename": self.name,
            "Content-Type": warc.INFO_TYPE,
        }
        self._put(warc.record(fields, b"format: WARC File Format 1.1\r\n"))

    def _put(self, record: bytes) -> None:
        packed = warc.member(record, self.settings.level)
        self.stream.write(packed)
        self.sha.update(packed)
        self.bytes += len(packed)


def _target(url: str | None, page_id: int | None) -> str:
    return f"urn:page:{page_id}" if url is None else warc.header_safe(url)


def _text(number: int | None) -> str | None:
    return None if number is None else str(number)


def _common(block: dict, copy: int, kind: str, date: str) -> dict[str, str | None]:
    return {
        "WARC-Type": kind,
        "WARC-Target-URI": _target(block["url"], block["page_id"]),
        "WARC-Date": date,
        "WARC-Record-ID": warc.record_id(f"{block['key']}:{copy}"),
        "Content-Type": warc.HTTP_TYPE,
        "WARC-Payload-Digest": f"sha1:{warc.base32_of_hex(block['digest'])}",
        warc.PAGE_FIELD: _text(block["page_id"]),
    }


def _responses(block: dict, payload: bytes, date: str) -> Iterator[bytes]:
    for copy in range(block["start"], block["start"] + block["responses"]):
        fields = _common(block, copy, warc.RESPONSE, date)
        yield warc.record(fields, warc.http_head(block["size"]) + payload)


def _revisits(block: dict, date: str) -> Iterator[bytes]:
    for copy in range(block["start"] + block["responses"], block["start"] + block["n"]):
        fields = _common(block, copy, warc.REVISIT, date) | {
            "WARC-Profile": warc.REVISIT_PROFILE,
            "WARC-Refers-To": warc.record_id(f"{block['kept_key']}:0"),
            "WARC-Refers-To-Target-URI": _target(block["kept_url"], block["kept_page_id"]),
            "WARC-Refers-To-Date": date,
            warc.REFERS_FIELD: _text(block["kept_page_id"]),
        }
        yield warc.record(fields, warc.http_head(block["size"]))


def _records(rows: Iterator[dict], date: str) -> Iterator[tuple[int, bytes]]:
    """Shard and bytes of each record, from rows in the order of the plan."""
    waiting: dict | None = None
    for row in rows:
        if row["n"] is None:  # a payload
            if waiting is not None and row["key"] == waiting["key"]:
                for record in _responses(waiting, row["payload"], date):
                    yield waiting["shard"], record
                waiting = None
            continue
        if waiting is not None:
            break
        if row["small"] is not None:
            for record in _responses(row, row["small"], date):
                yield row["shard"], record
        elif row["responses"]:
            waiting = row
        for record in _revisits(row, date):
            yield row["shard"], record
    if waiting is not None:
        raise warc.BrokenArchive(f"the payload of {waiting['key']} did not arrive")


def _writer(folder: str, settings: Settings):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        shard: _Shard | None = None
        written = []
        for number, record in _records(rows, settings.date):
            if shard is None or shard.shard != number:
                if shard is not None:
                    shard.close()
                    written += shard.written
                shard = _Shard(folder, settings, number)
            shard.add(record)
        if shard is not None:
            shard.close()
            written += shard.written
        names = ["shard", "number", "name", "temporary", "records", "bytes", "sha256"]
        types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        columns = [pa.array([w[i] for w in written], t) for i, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    return write


# -- commit ------------------------------------------------------------------------


def _committer(folder: str):
    """Moves files to their final names. Moving again what was moved does nothing."""

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                final = posixpath.join(root, row["name"])
                temporary = posixpath.join(root, row["temporary"])
                if files.get_file_info(temporary).type == pa.fs.FileType.File:
                    files.move(temporary, final)
                if files.get_file_info(final).size != row["bytes"]:
                    raise warc.BrokenArchive(f"{row['name']} has not the size that was written")
            yield batch.drop_columns(["temporary"])

    return commit


def write_archive(pages: DataFrame, folder: str, settings: Settings = Settings()) -> DataFrame:
    """Writes ``page_id, url, html`` as WARC files below ``folder``; returns the manifest.

    Each row becomes one record, in the order of page ids (NULL first). Among rows with
    equal payloads (a NULL ``html`` is an empty payload) the one with the largest page id is
    a response, and the others are revisits of it; among several of these, the largest by a
    hash of payload and URL, and of identical rows any. A row without a page id has no such
    field; one without a URL gets ``urn:page:`` and its id. Blanks and what is not ASCII are
    percent-encoded in the URLs of headers. An empty table gives no files. Other columns are
    left out. The same rows and settings give the same files, byte by byte.
    """
    spark = pages.sparkSession
    keyed = _keyed(pages)
    plan = _sharded(_blocks(keyed, settings.min_bytes), settings.shard_bytes)
    bounds = plan.groupBy("shard").agg(F.min(F.struct("key", "start")).alias("first"))
    bounds = sorted(bounds.collect(), key=lambda r: r["shard"])
    shards = [r["shard"] for r in bounds]
    firsts = [tuple(r["first"]) for r in bounds]
    payloads = keyed.select("key", "payload").mapInArrow(
        _dealt(firsts, shards), "shard int, key string, payload binary"
    )
    # A plan row of a key comes before its payloads: it has a number of copies.
    both = plan.unionByName(
        payloads.withColumn("start", F.lit(0).cast("long")), allowMissingColumns=True
    )
    dealt = both.repartitionById(max(shards, default=0) + 1, F.col("shard")).sortWithinPartitions(
        "shard", "key", "start", F.asc_nulls_last("n")
    )
    written = checkpointed(dealt.mapInArrow(_writer(folder, settings), _WRITTEN))
    committed = written.mapInArrow(_committer(folder), _WRITTEN.replace("temporary string, ", ""))
    committed.write.parquet(f"{folder}/{_MANIFEST}")
    files, root = _filesystem(folder)
    if files.get_file_info(left := posixpath.join(root, _TEMPORARY)).type == pa.fs.FileType.Directory:
        files.delete_dir(left)
    return manifest(spark, folder)


# -- read --------------------------------------------------------------------------


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files of an archive: ``shard, number, name, records, bytes, sha256``."""
    return spark.read.parquet(f"{folder}/{_MANIFEST}")


_READ = """page_id long, record_id string, record_type string, url string, payload_bytes long,
payload_digest string, refers_to_id string, refers_to long, payload binary"""


def _reader(folder: str, payloads: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                path = posixpath.join(root, row["name"])
                with files.open_input_stream(path, compression=None) as packed:
                    yield from _batched(_rows(gzip.GzipFile(fileobj=packed), payloads))

    return read


def _rows(stream, payloads: bool) -> Iterator[tuple]:
    for record in warc.records(stream):
        if record.kind == warc.INFO:
            continue
        head, body = record.http()
        digest = record.fields["warc-payload-digest"].removeprefix("sha1:")
        size = int(head["content-length"])
        if record.kind == warc.RESPONSE and (len(body), warc.base32_sha1(body)) != (size, digest):
            raise warc.BrokenArchive(f"the payload of {record.fields['warc-record-id']} changed")
        page_id = record.fields.get(warc.PAGE_FIELD.lower())
        refers_to = record.fields.get(warc.REFERS_FIELD.lower())
        yield (
            None if page_id is None else int(page_id),
            record.fields["warc-record-id"],
            record.kind,
            record.fields["warc-target-uri"],
            size,
            digest,
            record.fields.get("warc-refers-to"),
            None if refers_to is None else int(refers_to),
            body if payloads and record.kind == warc.RESPONSE else None,
        )


#: Payload bytes, and rows, of a batch that the reader hands on.
_BATCH_BYTES, _BATCH_ROWS = 16 << 20, 5_000


def _batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "record_id", "record_type", "url", "payload_bytes", "payload_digest",
             "refers_to_id", "refers_to", "payload"]
    whole, text = pa.int64(), pa.string()
    types = [whole, text, text, text, whole, text, text, whole, pa.binary()]
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or b"")
        if len(held) >= _BATCH_ROWS or size >= _BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def read_archive(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """The records of all files in the manifest, verified against their digests.

    ``payload_bytes`` and ``payload_digest`` (SHA-1 in base 32) are those of the whole
    payload, also for revisits; ``refers_to`` is the page that a revisit refers to. With
    ``payloads``, responses carry their payload. Raises :class:`warc.BrokenArchive` for
    bytes that are not what headers say.
    """
    listed = manifest(spark, folder)
    last = listed.agg(F.max("shard")).first()[0]
    dealt = listed.repartitionById((last or 0) + 1, F.col("shard")).select("name")
    return dealt.mapInArrow(_reader(folder, payloads), _READ)
