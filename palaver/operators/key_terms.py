"""Key terms: by how many messages hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scripts
from .tfidf import document_frequencies, postings


def coverage(docs: DataFrame) -> DataFrame:
    """term, messages_containing, unique_texts_containing: each message once."""
    return document_frequencies(postings(docs)).select("term", F.col("df_all").alias("messages_containing"), F.col("df_unique").alias("unique_texts_containing"))


def key_terms(docs: DataFrame, tops: DataFrame, unigrams: DataFrame, min_messages: int = 1) -> DataFrame:
    """term, script, unique_texts_containing, messages_containing, occurrences_all, occurrences_unique, repetition_ratio, tfidf_total_unique.

    Rows with fewer than min_messages unique texts go. The order is coverage, then term: see ranked().
    """
    counts = unigrams.select(F.col("ngram").alias("term"), F.col("count_all").alias("occurrences_all"), F.col("count_unique").alias("occurrences_unique"), "repetition_ratio")
    total = tops.where("variant = 'unique'").select("term", F.col("total_tfidf").alias("tfidf_total_unique"))
    out = coverage(docs).where(F.col("unique_texts_containing") >= min_messages).join(total, "term", "left").join(counts, "term", "left")
    return out.withColumn("script", scripts.token_script(F.col("term")))


def ranked(table: DataFrame, k: int) -> DataFrame:
    """The first k, with their rank."""
    order = [F.col("unique_texts_containing").desc(), F.col("term")]
    first = table.orderBy(*order).limit(k)
    return first.withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("long"))  # k rows


def verify(table: DataFrame, corpus: DataFrame) -> DataFrame:
    """Terms whose coverage differs from a count straight from the corpus."""
    own = corpus.select("is_repeat", F.explode(F.array_distinct("tokens_no_stopwords")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("m"), F.count_if(~F.col("is_repeat")).alias("u"))
    return table.join(own, "term", "left").where(~(F.col("messages_containing").eqNullSafe(F.col("m")) & F.col("unique_texts_containing").eqNullSafe(F.col("u")))).select("term")
