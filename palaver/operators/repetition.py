"""Repeated texts, as written and after masking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.constants import URL
from .activity import _long
from .corpus import numbered


def _sizes(corpus: DataFrame) -> DataFrame:
    """A row for each masked and raw text of a chat, with what its copies add up to."""
    day = F.to_date("datetime") if "datetime" in corpus.columns else F.lit(None).cast("date")
    rows = corpus.select("chat", "line_start", "text_masked", text.clean_raw(F.col("message")).alias("raw"), "is_forwarded", F.array_contains("tokens", URL).alias("has_url"), day.alias("date"))
    return rows.groupBy("chat", "text_masked", "raw").agg(
        F.count(F.lit(1)).alias("n"), F.min("line_start").alias("first"), F.bool_and("has_url").alias("url"), F.count_if("is_forwarded").alias("fwd"), F.min("date").alias("d0"), F.max("date").alias("d1"),
    )


def groups(corpus: DataFrame) -> DataFrame:
    """Templates with two copies or more: template_id (T1, T2, ... by first appearance), occurrences, repeat_messages, distinct_raw_texts, ..., active_dates."""
    g = _sizes(corpus).groupBy("chat", "text_masked").agg(
        F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("distinct_raw_texts"), F.bool_and("url").alias("contains_url"), F.sum("fwd").alias("forwarded_messages"),
        F.min("d0").alias("first_date"), F.max("d1").alias("last_date"), F.min("first").alias("first_line"),
    ).where("occurrences > 1")
    g = numbered(g, "first_line", "_number")
    if "datetime" in corpus.columns:  # dates are counted as rows of their own, never gathered
        days = corpus.select("chat", "text_masked", F.to_date("datetime").alias("_d")).where("_d is not null").distinct().groupBy("chat", "text_masked").agg(F.count(F.lit(1)).alias("active_dates"))
        g = g.join(days, ["chat", "text_masked"], "left")
    else:
        g = g.withColumn("active_dates", F.lit(0).cast("long"))
    g = g.withColumn("active_dates", F.coalesce("active_dates", F.lit(0).cast("long")))
    return g.select(
        "chat", F.concat(F.lit("T"), F.col("_number")).alias("template_id"), "occurrences", (F.col("occurrences") - 1).alias("repeat_messages"), "distinct_raw_texts", (F.col("distinct_raw_texts") == 1).alias("exact_raw_identical"),
        "contains_url", "forwarded_messages", F.date_format("first_date", "yyyy-MM-dd").alias("first_date"), F.date_format("last_date", "yyyy-MM-dd").alias("last_date"), "active_dates",
    )


def summary(corpus: DataFrame) -> DataFrame:
    """8 metrics with their denominators."""
    masked = corpus.groupBy("chat", "text_masked").agg(F.count(F.lit(1)).alias("n"))
    raw = corpus.groupBy("chat", text.clean_raw(F.col("message")).alias("raw")).agg(F.count(F.lit(1)).alias("n"))
    more = F.col("n") > 1
    a = masked.agg(F.sum("n").alias("texts"), F.count(F.lit(1)).alias("unique"), F.sum(F.col("n") - 1).alias("repeats"), F.count_if(more).alias("groups"), F.max("n").alias("largest"))
    b = raw.agg(F.count_if(more).alias("exact_groups"), F.sum(F.col("n") - 1).alias("exact_repeats"))
    c = F.col
    rows = [
        ("text_messages", c("texts"), c("texts"), "text messages"), ("unique_texts_after_masking", c("unique"), c("texts"), "text messages"), ("repeat_messages_after_masking", c("repeats"), c("texts"), "text messages"),
        ("template_groups", c("groups"), c("unique"), "unique texts"), ("largest_template_group_size", c("largest"), c("texts"), "text messages"), ("exact_raw_duplicate_groups", c("exact_groups"), c("texts"), "text messages"),
        ("exact_raw_repeat_messages", c("exact_repeats"), c("texts"), "text messages"), ("repeats_visible_only_after_masking", c("repeats") - c("exact_repeats"), c("repeats"), "repeat messages after masking"),
    ]
    return a.join(F.broadcast(b), F.lit(True)).select(F.inline(_long(rows)))  # one row each


def top_templates(table: DataFrame, k: int = 10) -> DataFrame:
    return table.orderBy(F.col("occurrences").desc(), "template_id").limit(k)
