"""Smoothed, L2-normalised TF-IDF on sparse postings, for both variants at once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scripts
from ..functions.constants import PHONE, URL
from ..plans.shared import remove, write_shared
from .corpus import VARIANTS, variant_rows

DIGITS = 12
#: Terms that are broadcast at most.
FREQUENT = 1 << 16


def documents(corpus: DataFrame) -> DataFrame:
    """corpus with terms (placeholders out), has_url and has_phone."""
    return corpus.withColumns({"has_url": F.array_contains("tokens", URL), "has_phone": F.array_contains("tokens", PHONE), "terms": F.filter("tokens_no_stopwords", lambda t: ~t.isin(URL, PHONE))})


def document_counts(docs: DataFrame) -> DataFrame:
    """variant, n: documents, empty ones too."""
    return variant_rows(docs.select("is_repeat")).groupBy("variant").agg(F.count(F.lit(1)).alias("n"))


def postings(docs: DataFrame) -> DataFrame:
    """chat, line_start, is_repeat, term, tf: one row serves both variants."""
    return docs.select("chat", "line_start", "is_repeat", F.explode("terms").alias("term")).groupBy("chat", "line_start", "is_repeat", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(p: DataFrame) -> DataFrame:
    """postings -> term, df_all, df_unique."""
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df_all"), F.count_if(~F.col("is_repeat")).alias("df_unique"))


def weights(docs: DataFrame) -> DataFrame:
    """variant, chat, line_start, term, tf, df, idf, tfidf_raw, tfidf_norm, rank_in_message, script.

    Postings, document frequencies and the join by term are made once for both variants, which part only when a document's rows have come together.
    """
    p = postings(docs)
    n = docs.agg(F.count(F.lit(1)).alias("n_all"), F.count_if(~F.col("is_repeat")).alias("n_unique"))
    idf = lambda v: (F.ln((1 + F.col(f"n_{v}")) / (1 + F.col(f"df_{v}"))) + 1).alias(f"idf_{v}")
    terms = document_frequencies(p).join(F.broadcast(n), F.lit(True)).select("term", "df_all", "df_unique", idf("all"), idf("unique"))  # n is one row
    x = p.join(terms, "term")
    doc = W.partitionBy("chat", "line_start", "is_repeat")
    norm = lambda v: F.sqrt(F.sum((F.col("tf") * F.col(f"idf_{v}")) * (F.col("tf") * F.col(f"idf_{v}"))).over(doc))
    x = x.withColumns({"_n_all": norm("all"), "_n_unique": norm("unique")})
    side = lambda v: F.struct(F.lit(v).alias("variant"), F.col(f"df_{v}").alias("df"), F.col(f"idf_{v}").alias("idf"), F.col(f"_n_{v}").alias("_norm"))
    x = x.select("chat", "line_start", "is_repeat", "term", "tf", F.inline(F.when(F.col("is_repeat"), F.array(side("all"))).otherwise(F.array(side("all"), side("unique")))))
    x = x.withColumn("tfidf_raw", F.col("tf") * F.col("idf")).withColumn("tfidf_norm", F.col("tfidf_raw") / F.col("_norm"))
    rank = F.row_number().over(W.partitionBy("chat", "line_start", "is_repeat", "variant").orderBy(F.round("tfidf_norm", DIGITS).desc(), "term"))
    return x.withColumn("rank_in_message", rank.cast("long")).drop("_norm", "is_repeat").withColumn("script", scripts.token_script(F.col("term")))


def long_table(docs: DataFrame) -> DataFrame:
    """weights with what is known of each document."""
    about = docs.select("chat", "line_start", "sender_anon", "is_forwarded", "is_repeat", "has_url", "has_phone")
    return weights(docs).join(about, ["chat", "line_start"])


def _total(x: Column) -> Column:
    """Sum of numbers from 0 to 1, the same in any order of the rows: whole multiples of 2^-30, and of 2^-60 for the rest, are added up. Equal totals so stay equal and share a rank."""
    high = F.floor(x * 2.0**30)
    rest = F.rint((x * 2.0**30 - high) * 2.0**30).cast("long")
    return F.sum(high) / 2.0**30 + F.sum(rest) / 2.0**60


def top_terms(weighted: DataFrame) -> DataFrame:
    """variant, term, script, df, idf, total_tfidf, mean_tfidf_in_docs, n_docs_top3."""
    total = _total(F.col("tfidf_norm"))
    return weighted.groupBy("variant", "term").agg(
        F.first("script").alias("script"), F.first("df").alias("df"), F.first("idf").alias("idf"), total.alias("total_tfidf"), (total / F.count(F.lit(1))).alias("mean_tfidf_in_docs"),
        F.count_if(F.col("rank_in_message") <= 3).alias("n_docs_top3"),
    )


def _ranked(tops: DataFrame) -> DataFrame:
    """tops with rank by total within the variant: ties share the lowest.

    A rank over a whole vocabulary would gather it in one task. Totals are counted by value instead, cut into ranges by value, and summed up from the top.
    """
    value = F.round("total_tfidf", DIGITS)
    counts = tops.groupBy("variant", value.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_range", F.floor(F.log2(F.col("_v") + 1e-12) * 64))
    ranges = counts.groupBy("variant", "_range").agg(F.sum("_n").alias("_all"))
    above = W.partitionBy("variant").orderBy(F.col("_range").desc()).rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("_above", F.coalesce(F.sum("_all").over(above), F.lit(0))).drop("_all")
    inside = W.partitionBy("variant", "_range").orderBy(F.col("_v").desc()).rowsBetween(W.unboundedPreceding, -1)
    ranks = counts.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(ranges, ["variant", "_range"])
    ranks = ranks.select("variant", "_v", (F.col("_in") + F.col("_above") + 1).alias("rank"))
    return tops.withColumn("_v", value).join(ranks, ["variant", "_v"]).drop("_v")


def variant_comparison(tops: DataFrame, unigrams: DataFrame | None = None) -> DataFrame:
    """term, total_tfidf_all, rank_all, total_tfidf_unique, rank_unique, rank_change[, count_all, count_unique]: one aggregation in place of a full join."""
    pick = lambda column, v: F.max(F.when(F.col("variant") == v, F.col(column))).alias(f"{column}_{v}")
    out = _ranked(tops).groupBy("term").agg(*[pick(c, v) for v in ("all", "unique") for c in ("total_tfidf", "rank")])
    out = out.withColumn("rank_change", F.col("rank_unique") - F.col("rank_all"))
    if unigrams is None:
        return out
    return out.join(unigrams.select(F.col("ngram").alias("term"), "count_all", "count_unique"), "term", "left")


def repetition_effect(comparison: DataFrame, k: int = 15) -> DataFrame:
    """The first k terms of a comparison by their rank among all messages."""
    return comparison.orderBy(F.col("rank_all").asc_nulls_last(), "term").limit(k)


def empty_documents(docs: DataFrame) -> DataFrame:
    """variant, chat, line_start of documents without a term."""
    return variant_rows(docs.where(F.size("terms") == 0).select("chat", "line_start", "is_repeat")).select("variant", "chat", "line_start")


def variant_metadata(docs: DataFrame) -> DataFrame:
    """One row a variant: documents, empty ones, vocabulary, repeats, forwarded, with links, with phone numbers."""
    sums = variant_rows(docs).groupBy("variant").agg(
        F.count(F.lit(1)).alias("n_documents"), F.count_if(F.size("terms") == 0).alias("n_empty_documents"), F.count_if("is_repeat").alias("n_repeat_documents"),
        F.count_if("is_forwarded").alias("n_forwarded_documents"), F.count_if("has_url").alias("n_documents_with_url"), F.count_if("has_phone").alias("n_documents_with_phone"),
    )
    sizes = document_frequencies(postings(docs)).agg(*[F.count_if(F.col(f"df_{v}") > 0).alias(v) for v in VARIANTS])
    vocabulary = sizes.select(F.inline(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("vocabulary_size")) for v in VARIANTS])))
    return sums.join(vocabulary, "variant", "left").withColumn("vocabulary_size", F.coalesce("vocabulary_size", F.lit(0)))


def top_list(tops: DataFrame, variant: str, k: int = 10) -> DataFrame:
    return tops.where(F.col("variant") == variant).orderBy(F.round("total_tfidf", DIGITS).desc(), "term").limit(k)


def top_overlap(tops: DataFrame, k: int = 10) -> DataFrame:
    """Share of the k best terms of one variant that are among those of the other."""
    a, b = (top_list(tops, v, k).select("term") for v in ("all", "unique"))
    return a.join(b, "term", "left_semi").agg((F.count(F.lit(1)) / F.lit(float(k))).alias("overlap"))


def stability_indices(n: int, full: int = 200, runs: int = 60) -> list[int]:
    """Which documents are left out: all, or `runs` of them evenly spaced."""
    if n <= full:
        return list(range(n))
    return sorted({round(k * (n - 1) / (runs - 1)) for k in range(runs)})


def _numbered(rows: DataFrame) -> DataFrame:
    """_n, _id: documents numbered from 0 in row order. Counts by range of lines are summed up, so no task sorts all rows."""
    rows = rows.select("chat", "line_start", "_id").withColumn("_range", F.coalesce(F.floor(F.col("line_start") / 1024), F.lit(-1)))
    counts = rows.groupBy("chat", "_range").agg(F.count(F.lit(1)).alias("_c"))
    above = W.orderBy("chat", "_range").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(above), F.lit(0))).drop("_c")
    inside = F.row_number().over(W.partitionBy("chat", "_range").orderBy("line_start", "_id")) - 1
    return rows.withColumn("_in", inside).join(counts, ["chat", "_range"]).select((F.col("_in") + F.col("_before")).alias("_n"), "_id")


def counted(terms: Column) -> Column:
    """The different terms of a document with their counts as one short string; a row is sorted by itself, nothing is shuffled."""
    starts = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    one = lambda s, at: F.transform(at, lambda i, j: F.concat(F.get(s, i), F.lit("\u0002"), (F.coalesce(F.get(at, j + 1), F.size(s)) - i).cast("string")))
    each = lambda s: F.transform(F.array(starts(s)), lambda at: F.array_join(one(s, at), "\u0001"))[0]
    return F.when(F.size(terms) > 0, F.transform(F.array(F.sort_array(terms)), each)[0]).otherwise("")


def _postings(rows: DataFrame, *keep: str) -> DataFrame:
    """keep, term, tf of rows with counted terms."""
    x = rows.where("counted <> ''").select(*keep, F.explode(F.split("counted", "\u0001")).alias("_t"))
    return x.select(*keep, F.substring_index("_t", "\u0002", 1).alias("term"), F.substring_index("_t", "\u0002", -1).cast("long").alias("tf"))


def leave_one_out(docs: DataFrame, k: int = 10, full: int = 200, runs: int = 60) -> DataFrame:
    """run (0, 1, ... in row order of the document left out), overlap: share of the k best terms that stay when it is left out. docs: one variant."""
    path = write_shared(docs.select("chat", "line_start", F.monotonically_increasing_id().alias("_id"), counted(F.col("terms")).alias("counted")), "counted")
    try:
        return leave_one_out_counted(docs.sparkSession.read.parquet(path), k, full, runs)
    finally:
        remove(docs.sparkSession, path)


def leave_one_out_counted(rows: DataFrame, k: int = 10, full: int = 200, runs: int = 60) -> DataFrame:
    """leave_one_out of a stored table chat, line_start, _id (of its own for each row), counted: one row a document.

    Leaving a document out changes N by one and df only for its own terms. So all runs share the sum of squares of a document's weights, and a run adds what
    its own terms change in it. No idf changes by more than known factors, so only terms whose total comes within these of the k-th best are
    summed up for each run: no other can be among the k best. Runs at once, so that what is stored is kept only as long; the result is one row a run.

    The most frequent terms (FREQUENT at most) meet a document's row by broadcast, so only the postings of the other terms are shuffled. What the runs change
    in a document are columns of one row, and the runs' totals are columns of one row a term.
    """
    spark = rows.sparkSession
    n = rows.count()
    picks = stability_indices(n, full, runs)
    if not picks:
        return spark.createDataFrame([], "run int, overlap double")
    at = {r["_n"]: r["_id"] for r in _numbered(rows).where(F.col("_n").isin(picks)).collect()}
    out = [at[i] for i in picks]
    made = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        made.append(write_shared(df, name))
        return spark.read.schema(df.schema).parquet(made[-1])

    try:
        # the runs whose document has a term are bits of whole numbers, 60 in each
        run = F.broadcast(spark.createDataFrame(list(enumerate(out)), "run int, _id long"))
        words = [f"_m{w}" for w in range((len(out) + 59) // 60)]
        bit = F.pow(F.lit(2.0), F.col("run") % 60).cast("long")
        own = _postings(rows.where(F.col("_id").isin(out)).join(run, "_id"), "run").groupBy("term").agg(*[F.sum(F.when(F.floor(F.col("run") / 60) == w, bit).otherwise(0)).alias(m) for w, m in enumerate(words)])
        df = _postings(rows).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        terms = kept(df.join(own, "term", "left").fillna(0, words), "terms")
        # idf with all documents, without one that lacks the term, and without one that has it
        whole, lacks, has = F.ln((1 + F.lit(n)) / (1 + F.col("df"))) + 1, F.ln(F.lit(n) / (1 + F.col("df"))) + 1, F.ln(F.lit(n) / F.col("df")) + 1
        mine = lambda r: F.col(words[r // 60]).bitwiseAND(F.lit(1 << (r % 60))) != 0
        cut = 0
        if terms.count() > FREQUENT:
            cut = terms.select("df").orderBy(F.col("df").desc()).limit(FREQUENT).agg(F.min("df")).first()[0]
        frequent = terms.where(F.col("df") > cut)

        def by_document(columns: list[Column], sums: list[Column]) -> DataFrame:
            """_id and sums over the postings with columns of their terms."""
            p = _postings(rows, "_id")
            x = p.join(F.broadcast(frequent.select("term", *columns)), "term").drop("term")
            if cut:
                rest = p.join(F.broadcast(frequent.select("term")), "term", "left_anti").join(terms.where(F.col("df") <= cut).select("term", *columns), "term").drop("term")
                x = x.unionByName(rest)
            return x.groupBy("_id").agg(*sums)

        norms = by_document([whole.alias("whole")], [F.sqrt(F.sum((F.col("tf") * F.col("whole")) * (F.col("tf") * F.col("whole")))).alias("norm")])
        shares = _postings(rows.select("_id", "counted").join(norms, "_id"), "norm").groupBy("term").agg(F.sum(F.col("tf") / F.col("norm")).alias("share"))
        base = kept(shares.join(terms, "term").select("term", "df", *words, F.round(whole * F.col("share"), DIGITS).alias("total")), "totals")
        best = base.orderBy(F.col("total").desc(), "term").limit(k).collect()
        least = 0.0
        if n > 2 and len(best) == k:
            # an idf falls by ln((1 + n) / n) at most and is 1 at least; a term of two documents gains the largest share, at most this
            low, high = 1 - math.log((1 + n) / n), 1 + 0.5 / (math.log((1 + n) / 3) + 1)
            least = (best[-1]["total"] - 1) * (low / high) ** 2 * (1 - 1e-9)  # a document adds 1 to a total at most
        some = base.where(F.col("total") >= least).drop("total")
        near = some.select("term")
        tf = _postings(rows, "_id").join(F.broadcast(near) if near.count() <= FREQUENT else near, "term")
        square = lambda c: F.col("tf") * F.col("tf") * F.col(c)
        sums = [F.sum(F.when(mine(r), square("more"))).alias(f"_c{r}") for r in range(len(out))]
        changed = by_document([(lacks * lacks).alias("lacks"), (has * has - lacks * lacks).alias("more"), *map(F.col, words)], [F.sum(square("lacks")).alias("squares"), *sums])
        of_run = lambda r: F.sum(F.when(F.col("_id") != out[r], F.col("tf") / F.sqrt(F.col("squares") + F.coalesce(f"_c{r}", F.lit(0.0)))))
        shares = tf.join(changed, "_id").groupBy("term").agg(*[of_run(r).alias(f"_s{r}") for r in range(len(out))])
        each = F.array(*[F.struct(F.lit(r).alias("run"), F.round(F.when(mine(r), has).otherwise(lacks) * F.col(f"_s{r}"), DIGITS).alias("total")) for r in range(len(out))])
        total = shares.join(some, "term").select("term", F.inline(each)).where("total is not null")
        top = total.withColumn("_r", F.row_number().over(W.partitionBy("run").orderBy(F.col("total").desc(), "term"))).where(F.col("_r") <= k)
        found = {r["run"]: r["c"] for r in top.where(F.col("term").isin([r["term"] for r in best])).groupBy("run").agg(F.count(F.lit(1)).alias("c")).collect()}
    finally:
        for path in made:
            remove(spark, path)
    return spark.createDataFrame([(r, found.get(r, 0) / k) for r in range(len(out))], "run int, overlap double")


def stability(docs: DataFrame, k: int = 10, full: int = 200, runs: int = 60) -> DataFrame:
    """One row: runs, mean_overlap, min_overlap, argmin (the first run with the least)."""
    return overlaps(leave_one_out(docs, k, full, runs))


def overlaps(each: DataFrame) -> DataFrame:
    """leave_one_out -> stability."""
    return each.agg(F.count(F.lit(1)).alias("runs"), F.bround(F.avg("overlap"), 4).alias("mean_overlap"), F.bround(F.min("overlap"), 4).alias("min_overlap"), F.min_by("run", F.struct("overlap", "run")).cast("long").alias("argmin"))
