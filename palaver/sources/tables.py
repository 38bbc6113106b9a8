"""Tables of documents, conversations and events in the message model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify, text
from .export import with_parts


def widened(df: DataFrame) -> DataFrame:
    """df dealt out to all cores if its files make fewer tasks than there are; a table of more tasks than cores stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def from_documents(documents: DataFrame) -> DataFrame:
    """One user row for each document; the source is the sender."""
    d = documents.select(F.lit("documents").alias("chat"), F.col("doc_id").alias("line_start"), F.col("source").alias("sender"), F.coalesce("text", F.lit("")).alias("message"))
    return d.withColumns({"message_type": F.lit("user"), "is_media": F.lit(False), "is_deleted": F.lit(False), "is_forwarded": classify.is_forwarded(F.col("message")), "clean_message": text.clean_text(F.col("message"))})


def from_conversations(conversations: DataFrame) -> DataFrame:
    """One row for each turn; the role is the sender, but for system turns."""
    system = F.col("role") == "system"
    c = conversations.select(
        F.col("conv_id").cast("string").alias("chat"), F.col("turn").alias("line_start"), F.when(~system, F.col("role")).alias("sender"),
        F.when(system, "system").otherwise("user").alias("message_type"), F.coalesce("text", F.lit("")).alias("message"),
    )
    user = F.col("message_type") == "user"
    c = c.withColumn("media_type", F.when(user, classify.media_type(F.col("message"))))
    return c.withColumns({"is_media": F.col("media_type").isNotNull(), "is_deleted": user & classify.is_deleted(F.col("message")), "is_forwarded": user & classify.is_forwarded(F.col("message")), "clean_message": text.clean_text(F.col("message"))})


def from_events(events: DataFrame) -> DataFrame:
    """One row for each event: views and clicks are text, purchases media, errors deleted, sign-ups system rows."""
    kind = F.col("event_type")
    e = events.select(F.lit("events").alias("chat"), F.col("event_id").alias("line_start"), F.col("ts").cast("timestamp_ntz").alias("datetime"), kind, F.col("user_id").cast("string").alias("_user"))
    e = e.withColumns({"message_type": F.when(kind == "signup", "system").otherwise("user"), "is_media": kind == "purchase", "is_deleted": kind == "error", "is_forwarded": F.lit(False), "message": kind})
    e = e.withColumn("sender", F.when(F.col("message_type") == "user", F.col("_user"))).withColumn("media_type", F.when(F.col("is_media"), "image"))
    return with_parts(e.drop("_user", "event_type"))
