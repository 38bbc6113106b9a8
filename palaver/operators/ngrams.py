"""N-gram counts with the effect of repetition, and script diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scripts, text
from ..functions.constants import STOPWORDS, TOKEN_SCRIPTS
from .corpus import with_repeats


def _rounded(x: Column, digits: int) -> Column:
    """Half to even on the number itself: bround goes by its shortest decimal text and makes 1.28 of 51 / 40, which is a little below 1.275."""
    return F.rint(x * 10.0**digits) / 10.0**digits


def ngram_table(corpus: DataFrame, n: int, tokens: str = "tokens") -> DataFrame:
    """ngram, count_all, count_unique (first copies of each token sequence), msgs_all, repetition_ratio.

    Copies are told by the tokens that are counted. Each row first counts its own n-grams, so the shuffle carries a row for each distinct n-gram of a message at most.
    """
    rows = corpus.select("chat", "line_start", F.col(tokens).alias("tokens"))
    rows = with_repeats(rows, "_copy", F.array_join("tokens", "\u0001")).select("chat", "line_start", "_copy", F.explode(text.ngrams(F.col("tokens"), n)).alias("ngram"))
    own = rows.groupBy("chat", "line_start", "_copy", "ngram").agg(F.count(F.lit(1)).alias("c"))
    out = own.groupBy("ngram").agg(F.sum("c").alias("count_all"), F.sum(F.when(~F.col("_copy"), F.col("c")).otherwise(0)).alias("count_unique"), F.count(F.lit(1)).alias("msgs_all"))
    return out.withColumn("repetition_ratio", _rounded(F.col("count_all") / F.nullif(F.col("count_unique"), F.lit(0)), 2))


def top(table: DataFrame, k: int, by: str = "count_all", name: str = "ngram") -> DataFrame:
    return table.orderBy(F.col(by).desc(), F.col(name)).limit(k)


def inflated(table: DataFrame, k: int = 15) -> DataFrame:
    """One row: the most frequent terms (k at most), and how many of them occur more often than in different texts."""
    return top(table, k).agg(F.count(F.lit(1)).alias("terms"), F.count_if(F.col("count_all") > F.col("count_unique")).alias("inflated"))


def token_counts(corpus: DataFrame) -> DataFrame:
    return corpus.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def script_diagnostics(corpus: DataFrame) -> DataFrame:
    """script, tokens_before and tokens_after stop words, pct_removed; a row for each script. Scripts are worked out once for each distinct token."""
    counts = token_counts(corpus).withColumn("script", scripts.token_script(F.col("token")))
    sums = counts.groupBy("script").agg(F.sum("n").alias("b"), F.sum(F.when(~F.col("token").isin(*STOPWORDS), F.col("n")).otherwise(0)).alias("a"))
    domain = corpus.sparkSession.createDataFrame([(s,) for s in TOKEN_SCRIPTS], "script string")
    out = domain.join(sums, "script", "left").select("script", F.coalesce("b", F.lit(0)).alias("tokens_before"), F.coalesce("a", F.lit(0)).alias("tokens_after"))
    return out.withColumn("pct_removed", F.when(F.col("tokens_before") > 0, _rounded(100.0 * (F.col("tokens_before") - F.col("tokens_after")) / F.col("tokens_before"), 1)))
