"""Broadcasts behind a check of their size, and Arrow batches of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def small_or_not(rows: DataFrame, most_bytes: int = 16 << 20) -> DataFrame:
    """rows with a broadcast hint if they come to at most that many bytes, 16 a column and the lengths of strings; else as they are, to be joined by shuffle."""
    width = F.lit(16 * len(rows.columns))
    for field in rows.schema:
        if field.dataType.typeName() in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0))
    total = rows.agg(F.sum(width.cast("long"))).first()[0] or 0
    return F.broadcast(rows) if total <= most_bytes else rows


def bounded_batches(spark: SparkSession, most_bytes: int = 4 << 20) -> None:
    """Let Arrow batches to and from Python workers hold some megabytes of text, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))
