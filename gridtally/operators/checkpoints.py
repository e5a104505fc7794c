"""Cutting a plan off from its lineage, in a folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of this session that all executors share, as a URI.

    It lies in ``spark.checkpoint.dir``. Only a session that names none gets one of its
    own, in the warehouse, which executors share as well.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        own = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", own))
    return context.getCheckpointDir()


def checkpointed(frame: DataFrame) -> DataFrame:
    """The frame, written to the :func:`shared_folder` and read from there."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()
