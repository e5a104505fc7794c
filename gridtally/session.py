"""Session settings the plans were designed with."""

from __future__ import annotations

from pyspark.sql import SparkSession

# All are run-time SQL settings, so they can be applied to a session somebody
# else started. Shuffle width is left alone: it belongs to the cluster, and
# adaptive execution coalesces it.
SETTINGS = {
    # Join strategy and shuffle width are decided from measured sizes.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # One meter may own a third of all rows: split its join partition, even
    # where the split costs one more exchange further up.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Times are kept as TIMESTAMP_NTZ and never pass through the session zone;
    # this only fixes how a stray TIMESTAMP would print.
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply :data:`SETTINGS` to a running session and return it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
