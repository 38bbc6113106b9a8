"""Mixing sources to target weights by Pareto order sampling.

Every document has an expected number of copies: its source's target over its source's size, times its importance if one is
given. The whole part is taken with certainty. The rest is an inclusion probability p, and Pareto order sampling decides: with a
random u of the document, the documents of a source are ranked by [u / (1 - u)] / [p / (1 - p)], and the first ones in that order are
taken until the words that the source still lacks are reached (the last one only if it brings the sum nearer to the target).

The order is never sorted as a whole. Ranks become 48-bit integers; histograms of words over their first bits, STEP more of them in each of LEVELS
rounds, show in which cell each source's cut lies, and only documents in that last cell are sorted. So a source that holds a third of all rows
is counted in partial sums on every task. What comes out is one row for each source: its target and the last document taken. Every row of docs then
tells by itself how often it is taken; texts are never shuffled.

Windows: the sources (one row each) go through one task, a source's histogram has at most 2^STEP rows, and its last cell has the documents of one
part in 2^(STEP * LEVELS) of the ranks (equal rows count once).

Defined results: null text has size 0; size 0 documents take nothing: their `taken` is 0, and `copies` tells how often they would come; size 0 sources
take nothing; a null source is a source, the last in order; a null doc_id draws like doc_id -1, and equal rows (doc_id, source, text) have equal draws: as many of
them as the cut asks for are taken; ties of different rows go by doc_id (null first), then text hash. An empty table gives an empty table. Columns of docs are
kept, whatever their names. Draws hash (seed, doc_id, text), so reruns and other partitionings agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialise

OUT = ("size", "source_size", "target", "copies", "taken")
#: Bits of the rank that each histogram looks at, the number of histograms, and the rank's bits.
STEP, LEVELS, BITS = 8, 3, 48


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), ratio: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes: source, source_size, one row per source. Adds weight and target.

    Targets share ratio * all sizes by weight, none above most * its source's size: target = min(most * size, level * weight).
    The level is found on the sources in the order in which they reach their limits. One row per source goes through one task.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("weight", F.get(turn, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
    s = s.withColumn("_full", F.col("source_size") * F.lit(float(most))).withColumn("_level", F.col("_full") / F.col("weight"))
    upto = W.orderBy("_level").rangeBetween(W.unboundedPreceding, 0)
    above = W.orderBy(F.col("_level").desc()).rangeBetween(W.unboundedPreceding, 0)
    s = s.withColumn("_rest", F.sum("weight").over(above))  # of those that are not full below this level
    s = s.withColumn("_equal", F.sum("weight").over(W.partitionBy("_level")))
    s = s.withColumn("_at", F.sum("_full").over(upto) + F.col("_level") * (F.col("_rest") - F.col("_equal")))
    s = s.withColumn("_goal", F.sum("source_size").over(W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * F.lit(float(ratio)))
    reach = F.when(F.col("_at") >= F.col("_goal"), F.col("_level") - (F.col("_at") - F.col("_goal")) / F.col("_rest"))
    every = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = F.coalesce(F.min_by(reach, F.when(reach.isNotNull(), F.col("_level"))).over(every), F.max("_level").over(every))
    s = s.withColumn("target", F.least(F.col("_full"), F.col("weight") * level))
    return s.select("source", "source_size", "weight", "target")


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("text").isNull())


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def _draws(rows: DataFrame, most: float, seed: int) -> DataFrame:
    """rows (doc_id, text_key, size, _imp) with their source's target and _mass: adds _whole, the certain copies, and _rank, null where there is nothing to draw."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id"), F.lit(-1).cast("long")), "text_key"), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    expect = F.when(F.col("_mass") > 0, F.least(F.lit(float(most)), F.col("target") * F.col("_imp") / F.col("_mass"))).otherwise(F.lit(0.0))
    d = rows.withColumns({"_u": u, "_e": expect}).withColumn("_whole", F.floor(F.col("_e") + 1e-12).cast("long"))
    p = F.greatest(F.lit(0.0), F.col("_e") - F.col("_whole"))
    odds = F.when((p > 0) & (F.col("size") > 0), F.col("_u") * (1 - p) / (F.col("_u") * (1 - p) + p * (1 - F.col("_u"))))  # q / (1 + q): the order of q, within 0 and 1
    return d.withColumn("_rank", F.least(F.floor(odds * float(1 << BITS)), F.lit((1 << BITS) - 1)).cast("long")).drop("_u", "_e")


def _importance(importance: str | None) -> Column:
    return F.greatest(F.coalesce(F.col(importance).cast("double"), F.lit(0.0)), F.lit(0.0)) if importance else F.lit(1.0)


def _sizes(docs: DataFrame, importance: str | None) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", text_key().alias("text_key"), word_count(F.col("text")).alias("size"), _importance(importance).alias("_imp"))
    return materialise(rows, "mix-sizes")


def cuts(slim: DataFrame, weights: tuple[float, ...], ratio: float, most: float, seed: int) -> DataFrame:
    """One row for each source: source, source_size, target, _mass, _bin, and the last document taken: _last (rank, doc_id, text_key) and how many of its equals, _some.

    _bin is null where the rest of the source is taken; documents in cells before it are taken.
    """
    sums = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("_imp") * F.col("size")).alias("_mass"))
    targets = source_targets(sums.select("source", "source_size"), weights, ratio, most)
    targets = materialise(sums.alias("a").join(targets.alias("b"), _same("a", "b")).select("a.source", "a._mass", "b.source_size", "b.target"), "mix-targets")
    d = _draws(slim.alias("d").join(targets.alias("t"), _same("d", "t")).select("d.*", "t.target", "t._mass"), most, seed)
    d = materialise(d.select("source", "doc_id", "text_key", "size", "target", "_whole", "_rank"), "mix-ranks")
    rest = d.groupBy("source").agg((F.first("target") - F.sum(F.col("_whole") * F.col("size"))).alias("_rest"))
    cell = None
    for level in range(1, LEVELS + 1):
        shift = BITS - STEP * level
        ranked = d.where("_rank is not null").groupBy("source", F.shiftright("_rank", shift).alias("_bin")).agg(F.sum("size").alias("_words"))
        if cell is None:
            bins = ranked.alias("d").join(rest.alias("r"), _same("d", "r")).select("d.source", "d._words", "d._bin", "r._rest", F.lit(0).cast("long").alias("_before"))
        else:
            inside = _same("d", "c") & (F.shiftright(F.col("d._bin"), STEP) == F.col("c._bin"))
            bins = ranked.alias("d").join(cell.alias("c"), inside).select("d.source", "d._words", "d._bin", "c._rest", "c._before")
        run = W.partitionBy("source").orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)
        bins = bins.withColumn("_upto", F.col("_before") + F.sum("_words").over(run)).withColumn("_start", F.col("_upto") - F.col("_words"))
        # the cut's cell: the first that reaches past the rest; where none does, all are taken
        cell = bins.where("_upto > _rest").groupBy("source").agg(F.min("_bin").alias("_bin"), F.min_by("_start", "_bin").alias("_before"), F.first("_rest").alias("_rest"))
        cell = materialise(cell, f"mix-cell{level}")
    near = d.where("_rank is not null").alias("d").join(cell.alias("c"), _same("d", "c") & (F.shiftright(F.col("d._rank"), shift) == F.col("c._bin")))
    # equal rows are one row with a number
    near = near.groupBy("d.source", "d._rank", "d.doc_id", "d.text_key", "d.size").agg(F.count(F.lit(1)).alias("_m"), F.first("c._before").alias("_before"), F.first("c._rest").alias("_rest"))
    last = W.partitionBy("source").orderBy("_rank", "doc_id", "text_key").rowsBetween(W.unboundedPreceding, 0)
    near = near.withColumn("_from", F.col("_before") + F.sum(F.col("size") * F.col("_m")).over(last) - F.col("size") * F.col("_m"))
    # the k-th of them is taken if half of it, after all before, still fits
    some = F.least(F.col("_m"), F.floor((F.col("_rest") - F.col("_from")) / F.greatest(F.col("size"), F.lit(1)) + 0.5)).cast("long")
    near = near.withColumn("_some", some).where("_some > 0").withColumn("_last", F.struct("_rank", "doc_id", "text_key"))
    near = near.groupBy("source").agg(F.max("_last").alias("_last"), F.max_by("_some", "_last").alias("_some"))
    out = targets.alias("t").join(cell.alias("c"), _same("t", "c"), "left").join(near.alias("n"), _same("t", "n"), "left")
    return materialise(out.select("t.*", "c._bin", "n._last", "n._some"), "mix-cuts")


def _decided(rows: DataFrame, by_source: DataFrame, most: float, seed: int) -> DataFrame:
    """rows (doc_id, source, text_key, size, _imp, ...) with _copies. Only equals of a source's last document are numbered."""
    names = rows.columns
    d = _draws(rows.alias("d").join(by_source.alias("t"), _same("d", "t")).select(*[F.col(f"d.`{n}`") for n in names], "t.source_size", "t.target", "t._mass", "t._bin", "t._last", "t._some"), most, seed)
    at = F.shiftright("_rank", BITS - STEP * LEVELS)
    mine = F.struct("_rank", "doc_id", "text_key")
    taken = F.col("_bin").isNull() | (at < F.col("_bin")) | ((at == F.col("_bin")) & F.coalesce(mine < F.col("_last"), F.lit(False)))
    d = d.withColumn("_in", F.coalesce(F.col("_rank").isNotNull() & taken, F.lit(False))).withColumn("_edge", F.coalesce(F.col("_rank").isNotNull() & (mine == F.col("_last")), F.lit(False)))
    edge = d.where("_edge").withColumn("_n", F.row_number().over(W.partitionBy("source").orderBy(F.lit(0)))).withColumn("_in", F.col("_n") <= F.col("_some")).drop("_n")
    return d.where("not _edge").unionByName(edge).withColumn("_copies", (F.col("_whole") + F.col("_in").cast("long")).cast("long"))


def mix_copies(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), ratio: float = 1.5, most: float = 2.0, seed: int = 17, importance: str | None = None) -> DataFrame:
    """docs (doc_id, text, source, ...) -> doc_id, source, text_key, size, source_size, target, copies, taken; a row for each row of docs.

    importance: a positive column; expected copies are proportional to it within a source (null or less than 0: 0), none above `most`.
    """
    slim = _sizes(docs, importance)
    out = _decided(slim, cuts(slim, weights, ratio, most, seed), most, seed)
    return out.select("doc_id", "source", "text_key", "size", "source_size", "target", F.col("_copies").alias("copies"), (F.col("_copies") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), ratio: float = 1.5, most: float = 2.0, seed: int = 17, importance: str | None = None) -> DataFrame:
    """docs with each row as often as the mix takes it; size 0 documents go. The columns stay as they are."""
    by_source = cuts(_sizes(docs, importance), weights, ratio, most, seed)
    # here a text's size matters only as none or some
    some = F.coalesce(F.col("text").cast("string").rlike(WORD), F.lit(False)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", text_key().alias("text_key"), some.alias("size"), _importance(importance).alias("_imp"), F.struct(*[F.col(f"`{n}`").alias(f"c{k}") for k, n in enumerate(docs.columns)]).alias("_row"))
    out = _decided(rows, by_source, most, seed).where("_copies > 0 and size > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*[F.col(f"_row.c{k}").alias(n) for k, n in enumerate(docs.columns)])
