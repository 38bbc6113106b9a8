"""Daily and hourly activity over a stream of prepared messages, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(prepared: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, text_messages, media_rows, deleted_rows, system_rows by window of event time. State is one row for each open window."""
    at = prepared.withColumn("_at", F.col("datetime").cast("timestamp")).withWatermark("_at", late)
    kinds = {"text_messages": F.col("kind") == "text", "media_rows": F.col("kind") == "media", "deleted_rows": F.col("kind") == "deleted", "system_rows": F.col("message_type") == "system"}
    return at.groupBy(F.window("_at", size)).agg(*[F.count_if(c).alias(k) for k, c in kinds.items()]).select(F.col("window.start").alias("start"), *kinds)


def first_copies(corpus: DataFrame, late: str = "2 days") -> DataFrame:
    """Rows of a stream that don't repeat an earlier text of their chat within the watermark."""
    return corpus.withColumn("_at", F.col("datetime").cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark(["chat", "text_masked"])
