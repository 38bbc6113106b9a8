"""The order of rows in what a run writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import WEEKDAYS
from ..operators.tfidf import DIGITS


def _number(column: str) -> Column:
    """The digits at the end of a name such as Participant_12 or T3."""
    return F.regexp_extract(column, r"([0-9]+)$", 1).try_cast("long")


def order(name: str) -> list[Column]:
    """What a table is sorted by; nothing for tables of a few fixed rows."""
    score = lambda c: F.round(c, DIGITS).desc()
    ngrams = [F.col("count_all").desc(), F.col("ngram")]
    by_name = {
        **dict.fromkeys(("ngram_unigrams", "ngram_unigrams_with_stopwords", "ngram_bigrams", "ngram_trigrams"), ngrams),
        "tfidf_terms_by_message": [F.col("variant"), F.col("chat"), F.col("line_start"), score("tfidf_norm"), F.col("term")],
        "tfidf_top_terms": [F.col("variant"), score("total_tfidf"), F.col("term")],
        "tfidf_variant_comparison": [F.col("rank_all").asc_nulls_last(), F.col("term")],
        "key_terms": [F.col("unique_texts_containing").desc(), F.col("term")],
        "analytics_sender_counts": [F.col("chat"), _number("participant_id")],
        "analytics_repetition_groups": [F.col("chat"), _number("template_id")],
        "analytics_daily_activity": [F.col("date")],
        "analytics_hour_histogram": [F.col("hour_as_exported")],
        "analytics_weekday_table": [F.array_position(F.array(*map(F.lit, WEEKDAYS)), F.col("weekday"))],
        "processed_chat": [F.col("chat"), F.col("line_start")],
        "analysis_corpus": [F.col("chat"), F.col("line_start")],
    }
    return by_name.get(name, [])


def ordered(name: str, df: DataFrame) -> DataFrame:
    """A global sort by ranges, so files and rows in them follow the order."""
    by = order(name)
    return df.orderBy(*by) if by else df


def ordered_file(name: str, df: DataFrame) -> DataFrame:
    """The same in one partition, for one file of a table that is small."""
    by = order(name)
    return df.repartition(1).sortWithinPartitions(*by) if by else df.repartition(1)
