"""Meter and document identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffix of meter ids in exports, name of a model document.
METER_SUFFIX = "_AMI"
DOCUMENT_PREFIX = "metered_savings_"
DOCUMENT_SUFFIX = ".txt"


def meter_id(raw: Column) -> Column:
    """Drop one trailing suffix (``x_AMI_AMI`` becomes ``x_AMI``).

    A suffix test instead of a regular expression: ``$`` would also match before
    a final line break.
    """
    bare = F.left(raw, F.length(raw) - F.lit(len(METER_SUFFIX)))
    return F.when(F.endswith(raw, F.lit(METER_SUFFIX)), bare).otherwise(raw)


def site_of_document(file_name: Column) -> Column:
    """Site id inside a document's file name; every occurrence of both marks goes."""
    without_prefix = F.replace(file_name, F.lit(DOCUMENT_PREFIX), F.lit(""))
    return F.replace(without_prefix, F.lit(DOCUMENT_SUFFIX), F.lit(""))
