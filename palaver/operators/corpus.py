"""The analysis corpus: text messages with tokens, pseudonyms and repeats; and its variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text

VARIANTS = ("all", "unique")


def conversational(messages: DataFrame) -> DataFrame:
    """User rows that are neither media nor deleted."""
    return messages.where((F.col("message_type") == "user") & ~F.col("is_media") & ~F.col("is_deleted"))


def pseudonyms(rows: DataFrame, prefix: str) -> DataFrame:
    """chat, sender, pseudonym: numbered by first appearance in the chat. One row per sender goes through the numbering."""
    first = rows.where("sender is not null").groupBy("chat", "sender").agg(F.min("line_start").alias("first_seen"))
    number = F.row_number().over(W.partitionBy("chat").orderBy("first_seen", "sender"))
    return first.withColumn("number", number.cast("long")).withColumn("pseudonym", F.concat(F.lit(prefix), "number"))


def masked_rows(messages: DataFrame) -> DataFrame:
    """Text messages with analysis tokens and masked text: one pass, no shuffle."""
    keep = [c for c in ("chat", "line_start", "sender", "is_forwarded", "message", "datetime") if c in messages.columns]
    rows = conversational(messages).select(*keep, text.analysis_tokens(F.col("clean_message")).alias("tokens"))
    return rows.withColumn("text_masked", F.array_join("tokens", " "))


def with_repeats(rows: DataFrame, flag: str = "is_repeat", key: Column | None = None) -> DataFrame:
    """Flags later copies of a text in its chat; a row without a line is none.

    Texts are told by 128 bits of hash. First lines are found by partial minima over narrow rows (chat, hashes, line), so a text with a third of all rows is one
    row of the join; the wide rows meet only the lines of repeats.
    """
    key = F.col("text_masked") if key is None else key
    keyed = rows.withColumns({"_h1": F.xxhash64(key), "_h2": F.xxhash64(F.lit(1), F.reverse(key))})
    lines = keyed.select("chat", "_h1", "_h2", "line_start")
    first = lines.groupBy("chat", "_h1", "_h2").agg(F.min("line_start").alias("_first"))
    repeats = lines.join(first, ["chat", "_h1", "_h2"]).where("line_start > _first").select("chat", "_h1", "_h2", "line_start", F.lit(True).alias("_again")).distinct()
    out = keyed.join(repeats, ["chat", "_h1", "_h2", "line_start"], "left")
    return out.select(*rows.columns, F.coalesce("_again", F.lit(False)).alias(flag))


def numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """rows numbered from 1 in their chat in the order of a line column. Counts by range of lines are summed up, so no task sorts all rows of a chat."""
    rows = rows.withColumn("_range", F.coalesce(F.floor(F.col(by) / 1024), F.lit(-1)))
    counts = rows.groupBy("chat", "_range").agg(F.count(F.lit(1)).alias("_c"))
    above = W.partitionBy("chat").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(above), F.lit(0))).drop("_c")
    inside = F.row_number().over(W.partitionBy("chat", "_range").orderBy(by))
    return rows.withColumn("_in", inside).join(counts, ["chat", "_range"]).withColumn(name, F.col("_in") + F.col("_before")).drop("_range", "_in", "_before")


def build_corpus(messages: DataFrame, stopwords: bool = True) -> DataFrame:
    """messages -> chat, line_start, sender, sender_anon, is_forwarded, message, tokens, tokens_no_stopwords, text_masked, is_repeat[, datetime]."""
    rows = with_repeats(masked_rows(messages))
    names = pseudonyms(rows, "Sender_").select("chat", "sender", F.col("pseudonym").alias("sender_anon"))
    out = rows.join(names, ["chat", "sender"], "left")
    return out.withColumn("tokens_no_stopwords", text.remove_stopwords(F.col("tokens"))) if stopwords else out


def variant_rows(corpus: DataFrame) -> DataFrame:
    """Every row once for each variant it is in, so that one aggregation serves both."""
    both = F.when(F.col("is_repeat"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("unique")))
    return corpus.withColumn("variant", F.explode(both))


def select_variant(corpus: DataFrame, variant: str) -> DataFrame:
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant: {variant}")
    return corpus if variant == "all" else corpus.where(~F.col("is_repeat"))

