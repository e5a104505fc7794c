"""Listing the files below a folder, on the executors.

Spark's own readers leave out files of zero bytes, and hand names to Python only through
the driver. Here a table of folders becomes the table of their entries, and the folders
among these are the next level, so the names stay in tables and many folders are listed
at once. Folders are reached through ``pyarrow.fs``: local and shared disks, HDFS, S3 and
GCS.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtally.operators.checkpoints import checkpointed

_ENTRY = "path string, name string, is_folder boolean, length long"
_COLUMNS = pa.schema(
    [("path", pa.string()), ("name", pa.string()), ("is_folder", pa.bool_()), ("length", pa.int64())]
)
#: Entries that a task hands on together.
_BATCH = 10_000


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, as Spark's readers name it; local ones with three slashes."""
    if not re.match(r"^[a-z][a-z0-9+.-]*:/", folder):
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS")
        local = default.startswith("file:")
        folder = default.rstrip("/") + "/" + (os.path.abspath(folder) if local else folder).lstrip("/")
    return re.sub("^file:/+", "file:///", folder).rstrip("/")


def _filesystem(uri: str) -> tuple[pa.fs.FileSystem, str, str]:
    """File system, path in it, and what stands before the path in Spark's names."""
    if uri.startswith("file:///"):
        return pa.fs.LocalFileSystem(), uri.removeprefix("file://"), "file://"
    files, path = pa.fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))
    return files, path, uri[: len(uri) - len(path)] if uri.endswith(path) else ""


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The visible entries of each folder; none for a folder that has vanished."""
    for batch in batches:
        for uri in batch.column("path").to_pylist():
            files, path, before = _filesystem(uri)
            found = files.get_file_info(pa.fs.FileSelector(path, allow_not_found=True))
            shown = [i for i in found if not i.base_name.startswith((".", "_"))]
            for start in range(0, len(shown), _BATCH):
                part = shown[start : start + _BATCH]
                is_folder = [i.type == pa.fs.FileType.Directory for i in part]
                columns = [
                    [f"{before}{i.path}" for i in part], [i.base_name for i in part], is_folder,
                    [None if folder else i.size for i, folder in zip(part, is_folder)],
                ]
                arrays = [pa.array(c, f.type) for c, f in zip(columns, _COLUMNS)]
                yield pa.RecordBatch.from_arrays(arrays, schema=_COLUMNS)


def list_files(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """``path, name, length`` of all files below ``folder`` whose names end in ``suffix``.

    Names that start with ``.`` or ``_``, and what lies in folders named so, are left out.
    The list is written level by level, so files that vanish afterwards are still on it.
    """
    level = spark.range(1).select(F.lit(qualified(spark, folder)).alias("path"))
    levels = []
    while not level.isEmpty():
        entries = checkpointed(level.mapInArrow(_entries, _ENTRY))
        levels.append(entries.filter(~F.col("is_folder") & F.endswith("name", F.lit(suffix))))
        # One folder may be slow to list: they are dealt out one by one.
        level = entries.filter("is_folder").select("path").repartition("path")
    return reduce(DataFrame.unionByName, levels).drop("is_folder")
