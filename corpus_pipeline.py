"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next one's docs. All but the
last keep the columns of documents, whatever columns there are beside doc_id, text, lang and source, and whatever their names.

Defined results, stage by stage: language ID drops rows whose text is null or has no letter; later stages would keep them (near-duplicates, decontamination) or drop them as rows of no
word (mixing). Empty texts go with them. Very long texts are used whole in every stage. Repeated rows, and rows of one doc_id with linked texts, become one row in the
near-duplicate stage; of several candidates the least doc_id stays, then the least text hash. Rows with a null doc_id link with nothing and stay; they draw like doc_id -1 in mixing
and come first in the token files. A null source is a source. Mixing may give a row twice; ties of its ranks go by doc_id and text hash. An empty table, and one that
becomes empty on the way, gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palaver.llm import common, decontaminate, lang_id, mixing, ngram_join, token_store


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in no known language: no letters, or far from every profile."""
    return lang_id.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; rows that share a doc_id go only if their texts are linked."""
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold passages of the benchmark, also re-parameterised ones."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Written as token files; what was read back from them."""
    return token_store.store_tokens(docs)


STAGES = [("language ID", language), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("mixing sources", mix), ("token-ID output", tokens)]

#: SQL can't express rank-order profiles, Pareto sampling by hashes, or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialise(docs, f"pipeline-{k}")
    return docs
