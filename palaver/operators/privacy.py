"""What may be published: allow-listed tables, no internal columns, no rare or private-looking terms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import looks_sensitive
from ..plans.config import UserFacingError

# The tables that may leave a run, and the columns that may not.
ANALYTICS = ("analytics_row_composition", "analytics_metadata_counts", "analytics_daily_activity", "analytics_repetition_summary", "analytics_repetition_groups", "analytics_sender_counts", "analytics_hour_histogram", "analytics_weekday_table", "analytics_text_length_summary")
NLP = ("ngram_unigrams", "ngram_unigrams_with_stopwords", "ngram_bigrams", "ngram_trigrams", "ngram_script_diagnostics", "tfidf_top_terms", "tfidf_variant_comparison", "script_mix_summary", "script_mixing_stats", "key_terms")
FORBIDDEN = frozenset({"sender", "message", "clean_message", "text_masked", "tokens", "tokens_no_stopwords", "line_start", "line_end"})
TERM = {"ngram_unigrams": "ngram", "ngram_unigrams_with_stopwords": "ngram", "ngram_bigrams": "ngram", "ngram_trigrams": "ngram", "tfidf_top_terms": "term", "tfidf_variant_comparison": "term", "key_terms": "term"}
TFIDF = ("tfidf_top_terms", "tfidf_variant_comparison")
# What metadata must not carry (terms, and positions in the export).
PRIVATE_META = ("top10_terms_by_total_tfidf", "empty_document_line_start")


def approved(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The allow-listed tables; an internal column in one of them is an error."""
    out = {k: tables[k] for k in (*ANALYTICS, *NLP) if k in tables}
    for name, df in out.items():
        if FORBIDDEN & set(df.columns):
            raise UserFacingError("output_withheld", f"{name} holds a column that may not be published.")
    return out


def redacted(meta: dict) -> dict:
    return {k: redacted(v) if isinstance(v, dict) else v for k, v in meta.items() if k not in PRIVATE_META}


def rare_terms(tops: DataFrame, min_messages: int) -> DataFrame:
    return tops.where((F.col("variant") == "all") & (F.col("df") < min_messages)).select("term")


def _marked(tables: dict[str, DataFrame], name: str, min_messages: int, show_single: bool) -> DataFrame:
    """A table with _rare (a term of too few messages) and _private (a private-looking one)."""
    df, rare = tables[name], F.lit(False)
    counts = {"ngram": "msgs_all"}.get(TERM[name], "messages_containing")
    if not show_single:
        if name in TFIDF and "tfidf_top_terms" in tables:
            df = df.join(rare_terms(tables["tfidf_top_terms"], min_messages).withColumn("_few", F.lit(True)), "term", "left")
            rare = F.coalesce("_few", F.lit(False))
        elif counts in df.columns:
            rare = F.col(counts) < min_messages
    return df.withColumns({"_rare": rare, "_private": looks_sensitive(F.col(TERM[name]))}).drop("_few")


def display_tables(tables: dict[str, DataFrame], min_messages: int = 2, show_single: bool = False) -> dict[str, DataFrame]:
    """Copies of the tables without terms of fewer than min_messages messages and without private-looking ones."""
    shown = {name: _marked(tables, name, min_messages, show_single).where("not _rare and not _private").drop("_rare", "_private") for name in TERM if name in tables}
    return {**tables, **shown}


def display_notice(tables: dict[str, DataFrame], min_messages: int = 2, show_single: bool = False) -> DataFrame:
    """One row on what display_tables() hides in all the tables: rows of rare terms, and private-looking ones among the rest."""
    hidden = lambda df: df.agg(F.count_if("_rare").alias("rare"), F.count_if(~F.col("_rare") & F.col("_private")).alias("private"))
    parts = [hidden(_marked(tables, name, min_messages, show_single)) for name in TERM if name in tables]
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return reduce(DataFrame.unionByName, parts).agg(
        F.lit(min_messages).alias("min_messages"), F.lit(show_single).alias("shown_single_message_terms"), total("rare").alias("rows_hidden_single_message"), total("private").alias("rows_hidden_sensitive_pattern")
    )


def hidden_counts(table: DataFrame, column: str, count: str, min_messages: int = 2) -> DataFrame:
    """One row: how many terms are hidden for being rare, and for looking private among the rest."""
    rare = F.col(count) < min_messages
    return table.agg(F.count_if(rare).alias("hidden_rare"), F.count_if(~rare & looks_sensitive(F.col(column))).alias("hidden_sensitive"))
