"""Report sinks: CSV folders, with ``NA`` for missing values and ``TRUE`` and ``FALSE``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtally.sources.tables import MISSING


def write_csv(df: DataFrame, path: str, quote_all: bool = False, one_file: bool = False) -> None:
    """Write a CSV folder with a header, replacing what is there.

    ``one_file`` is for report tables with a handful of rows per event or site
    count; leave it off for anything that grows with the readings.
    """
    words = {
        name: F.upper(F.col(name).cast("string")) for name, kind in df.dtypes if kind == "boolean"
    }
    out = (df.coalesce(1) if one_file else df).withColumns(words)
    out.write.mode("overwrite").csv(
        path, header=True, nullValue=MISSING, quoteAll=quote_all, escape='"'
    )


def write_table(df: DataFrame, path: str, *partitions: str) -> DataFrame:
    """Write a Parquet table and return it read back.

    Several analyses can then share one prepared table without recomputing it,
    and a lost executor costs no more than its own tasks.
    """
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
