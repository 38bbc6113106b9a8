"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of shingles: every WORDS consecutive words ([^\\x20\\x09-\\x0D]+, A-Z in lower case); a document of fewer words, but at least one, is the
set of that one shorter run. Two documents are linked if the Jaccard similarity of their sets is at least THRESHOLD.

1. One pass over the texts makes, for each document, a 128-bit key of its set and a signature of HASHES minimum hashes. Documents with equal sets are one class.
2. BANDS keys of ROWS minimum hashes each find candidates: classes that share a key. A pair of similarity 0.8 shares none with probability 0.59^20 (under 3 in 100,000).
   Keys of a single class go at once.
3. Classes under a key are cut into blocks of about TILE classes and TILE_SHINGLES shingles, and blocks meet in tiles, so a hot key is many tasks' work. A pair
   counts only under the first key it shares, which is judged on the very values that the keys are made of.
   Its signatures are compared STEP values at a time, and it is dropped as soon as the posterior probability (uniform prior) of a similarity of
   THRESHOLD or more falls below TOLERANCE.
4. Only classes with a pair left fetch their text; the pairs left are verified exactly on their shingles.
5. A tile gives sums of links and local components, never pairs. Connected components over these give class_id.

Defined results: null, empty and blank texts link with nothing. Equal texts, and repeated rows, link with each other. Rows that share a doc_id but not
their text are documents of their own: links are between rows, and only names, such as class_id, are shared. A null doc_id links with nothing and has a null
class_id. Very long texts are used whole. An empty table gives an empty table. Other columns aren't used, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, blocks, discard, mapped, materialise, mix, parts, span_hash, text_buffer, window_hash, word_spans
from .embed_dedup import roots
from .graph import components

WORDS, THRESHOLD = 5, 0.8
HASHES, BANDS, ROWS = 128, 20, 4
STEP, TOLERANCE = 16, 1e-6
TILE, TILE_SHINGLES = 1024, 1 << 20
#: Pairs that are looked at together.
CHUNK = 1 << 20

FEATURES = "doc_id long, t long, k1 long, k2 long, n int, sig binary, bands binary"
_generator = np.random.Generator(np.random.PCG64(20))
_MULTIPLIERS = _generator.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_ADDENDS = _generator.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def shingles(buf: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    for _, _, part, at in blocks(buf, offsets):
        low = LOWER[part]
        starts, ends, first = word_spans(low, at)
        values, begin = window_hash(span_hash(low, starts, ends), first, words)
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            some = np.sort(values[a:b])
            yield some if len(some) < 2 else some[np.concatenate([[True], some[1:] != some[:-1]])]


def set_key(values: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of 64-bit values."""
    a = mix(values)
    with np.errstate(over="ignore"):
        k1 = int(np.add.reduce(a, dtype=np.uint64))
        k2 = int(np.add.reduce(mix(a ^ np.uint64(0xD6E8FEB86659FD93)), dtype=np.uint64))
    return k1 - (1 << 64) * (k1 >> 63), k2 - (1 << 64) * (k2 >> 63)


def signature(values: np.ndarray) -> np.ndarray:
    """HASHES minimum hashes, 32 bits each."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 4096):
        np.minimum(out, (x[None, a : a + 4096] * _MULTIPLIERS[:, None] + _ADDENDS[:, None]).min(axis=1), out=out)
    return out


def least_matches(threshold: float, tolerance: float, hashes: int = HASHES, step: int = STEP) -> list[int]:
    """For step, 2 * step, ... values: the fewest matches with which P(similarity >= threshold) is tolerance or more.

    With a uniform prior and m matches of n the posterior is Beta(m + 1, n - m + 1), whose upper tail is a binomial sum.
    """
    out = []
    for n in range(step, hashes + 1, step):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def features(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_buffer(batch.column(1))
            k1, k2, n, sig, bands = [], [], [], [], []
            for s in shingles(buf, offsets):
                n.append(len(s))
                if not len(s):
                    for x in (k1, k2, sig, bands):
                        x.append(None)
                    continue
                a, b = set_key(s)
                k1.append(a)
                k2.append(b)
                full = (signature(s) & np.uint32(0xFFFF)).astype("<u2")
                sig.append(full.tobytes())
                bands.append(band_keys(full).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(n, pa.int32()), pa.array(sig, pa.binary()), pa.array(bands, pa.binary())], ["doc_id", "t", "k1", "k2", "n", "sig", "bands"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_id().alias("t")), "ngram_join", run, FEATURES)


def text_id() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A key for each band, of the signature's own values."""
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[r : BANDS * ROWS : ROWS].astype(np.uint64))
    return key.astype("<u8")


def band_rows(classes: DataFrame) -> DataFrame:
    """node, bands, n -> node, band, key, n: BANDS rows a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            if len(nodes):
                keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes, BANDS)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(nodes))), pa.array(keys), pa.array(np.repeat(batch.column(2).to_numpy(), BANDS))], ["node", "band", "key", "n"])

    return mapped(classes.select("node", "bands", "n"), "ngram_join", run, "node long, band int, key long, n int")


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by their first column -> tables of whole groups."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        keys = table.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
    if rest is not None:
        yield rest


def pairs_of(groups: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within groups of equal, adjacent values, CHUNK or so at a time."""
    n = len(groups)
    end = np.searchsorted(groups, groups, "right")
    count = end - np.arange(n) - 1
    upto = np.cumsum(count)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + CHUNK, "right")))
        c = count[a:b]
        if c.sum():
            i = np.repeat(np.arange(a, b), c)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
            yield i, j
        a = b


def surviving(tile: np.ndarray, band: np.ndarray, side: np.ndarray, sig: np.ndarray, least: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of a tile that its key is the first to bring together and that the comparison of their signatures leaves.

    side: 0 for a tile of a block with itself, else 1 and 2 for its blocks, of which only pairs across count.
    """
    for i, j in pairs_of(tile):
        across = (side[i] != side[j]) | (side[i] == 0)
        i, j = i[across], j[across]
        matches = np.zeros(len(i), np.int32)
        for k, m in enumerate(least):
            matches += (sig[i, k * STEP : (k + 1) * STEP] == sig[j, k * STEP : (k + 1) * STEP]).sum(axis=1, dtype=np.int32)
            keep = matches >= m
            if not k:  # the first key that both have must be this one
                same = (sig[i, : BANDS * ROWS] == sig[j, : BANDS * ROWS]).reshape(-1, BANDS, ROWS).all(axis=2) if len(i) else np.zeros((0, BANDS), bool)
                keep &= same.any(axis=1) & (same.argmax(axis=1) == band[i])
            i, j, matches = i[keep], j[keep], matches[keep]
        if len(i):
            yield i, j


def verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sets have Jaccard similarity >= threshold, exactly: |A n B| (1 + t) >= t (|A| + |B|)."""
    size = np.array([len(s) for s in sets])
    used = np.unique(np.concatenate([i, j]))
    place = np.zeros(len(sets), np.int64)
    place[used] = np.arange(len(used))
    lengths = size[used]
    flat = np.concatenate([sets[k] for k in used])
    order = np.argsort(flat, kind="stable")
    line = flat[order]
    fresh = np.concatenate([[True], line[1:] != line[:-1]])
    code = np.cumsum(fresh) - 1
    often = np.diff(np.append(np.flatnonzero(fresh), len(line))) > 1  # shingles of one set alone can't be shared
    column = (np.cumsum(often) - 1)[code]
    row = np.repeat(np.arange(len(used)), lengths)[order]
    shared = often[code]
    row, column = row[shared], column[shared]
    total = np.zeros(len(i), np.int64)
    width = 1 << 15  # columns at a time
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    for a in range(0, int(often.sum()), width):
        part = slice(int(np.searchsorted(column, a)), int(np.searchsorted(column, a + width)))
        bits = np.zeros((len(used), (width if often.sum() - a > width else int(often.sum()) - a + 63) // 64), np.uint64)
        c = column[part] - a
        np.bitwise_or.at(bits, (row[part], c >> 6), np.uint64(1) << (c & 63).astype(np.uint64))
        step = max(1, (1 << 20) // max(1, bits.shape[1]))
        for b in range(0, len(i), step):
            total[b : b + step] += np.bitwise_count(bits[place[i[b : b + step]]] & bits[place[j[b : b + step]]]).sum(axis=1, dtype=np.int64)
    return total * (1 + threshold) >= threshold * (size[i] + size[j]) - 1e-9


def _signatures(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, HASHES)


def linked_rows(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, t (the text's hash), component, class_id, n_links, first: a row for each row; the last four are null where there is no link.

    first: a row of the component's least doc_id, in the class that names the component.
    """
    least = least_matches(threshold, tolerance)
    feats = materialise(features(docs), "features")
    classes = feats.where("k1 is not null and doc_id is not null").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "t")).alias("pick"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("node"), F.col("pick.doc_id").alias("rep"), F.col("pick.t").alias("t"), "k1", "k2", "copies", "n", "sig", "bands"), "classes")

    rows = band_rows(classes)
    cuts = F.greatest(F.ceil(F.col("m") / F.lit(TILE)), F.ceil(F.col("size") / F.lit(TILE_SHINGLES)))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("size")).where("m > 1").select("key", F.least(cuts, F.col("m")).alias("cuts"))
    members = materialise(rows.join(shared, "key").select("key", "band", "node", "cuts"), "members")
    block = F.pmod(F.xxhash64("node"), F.col("cuts"))
    met = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(low == high, 0).when(F.col("block") == low, 1).otherwise(2)
    met = met.select(F.xxhash64("key", low, high).alias("tile"), "band", side.cast("int").alias("side"), "node")
    with_sig = met.join(classes.select("node", "rep", "sig", "copies"), "node").select("tile", "band", "side", "node", "sig", "copies", "rep")

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches):
            tile, band, sides, node = (table.column(k).to_numpy() for k in range(4))
            use = np.zeros(len(tile), bool)
            for i, j in surviving(tile, band, sides, _signatures(table.column(4)), least):
                use[i] = use[j] = True
            if use.any():
                yield table.filter(pa.array(use)).combine_chunks().to_batches()[0]

    n = parts(docs)

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(n, "tile").sortWithinPartitions("tile")

    kept = materialise(mapped(dealt(with_sig), "ngram_join", wanted, "tile long, band int, side int, node long, sig binary, copies long, rep long"), "candidates")
    # the plan is the same at every size: texts are dealt by id once, and candidates, which grow with the corpus, are never broadcast
    asked = classes.join(kept.select("node").distinct(), "node", "left_semi").select("node", "rep", "t")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), text_id().alias("t"), F.col("text").cast("string").alias("text"))
    texts = texts.join(asked.hint("shuffle_hash"), ["rep", "t"]).select("node", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_buffer(batch.column(1))
            for first, end, part, at in blocks(buf, offsets):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array([s.tobytes() for s in shingles(part, at)], pa.binary())], ["node", "shingles"])

    sets = mapped(texts, "ngram_join", cut, "node long, shingles binary")
    checked = kept.join(sets, "node").select("tile", "band", "side", "node", "sig", "copies", "rep", "shingles")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches):
            order = np.lexsort((table.column(3).to_numpy(), table.column(0).to_numpy()))
            once = order[np.concatenate([[True], (np.diff(table.column(0).to_numpy()[order]) != 0) | (np.diff(table.column(3).to_numpy()[order]) != 0)])]
            if len(once) < len(order):  # a row of docs that is there twice brings its class twice
                table = table.take(pa.array(np.sort(once)))
            tile, band, sides, node = (table.column(k).to_numpy() for k in range(4))
            copies, rep = table.column(5).to_numpy(), table.column(6).to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in table.column(7).to_pylist()]
            links = np.zeros(len(tile), np.int64)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for i, j in surviving(tile, band, sides, _signatures(table.column(4)), least):
                # a tile at a time: pairs come in the order of their tiles
                edge = np.flatnonzero(np.concatenate([[True], tile[i[1:]] != tile[i[:-1]]])) if len(i) else np.zeros(0, np.int64)
                for a, b in zip(edge, np.append(edge[1:], len(i)), strict=True):
                    base, top = int(i[a:b].min()), int(j[a:b].max()) + 1
                    good = verified(sets[base:top], i[a:b] - base, j[a:b] - base, threshold)
                    x, y = i[a:b][good], j[a:b][good]
                    np.add.at(links, x, copies[y])
                    np.add.at(links, y, copies[x])
                    found.append((x, y))
            hit = np.flatnonzero(links)
            if len(hit):
                order = np.lexsort((node, rep))  # the least class of a component is that of its least doc_id
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                root = order[roots(len(node), [(place[a], place[b]) for a, b in found])][place][hit]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[hit], rep[hit], links[hit], node[root], rep[root])], ["node", "rep", "links", "root", "root_rep"])

    found = materialise(mapped(dealt(checked), "ngram_join", linked, "node long, rep long, links long, root long, root_rep long"), "links")
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    # a node is (doc_id, class), so that a component's least node names it
    edges = found.where("node <> root").select(F.struct("rep", "node").alias("a"), F.struct(F.col("root_rep").alias("rep"), F.col("root").alias("node")).alias("b"))
    comp = components(edges).select(F.col("node.node").alias("_node"), "component")
    state = classes.select("k1", "k2", "rep", "node", "copies").join(sums, "node", "left").join(comp, F.col("node") == F.col("_node"), "left")
    top = F.coalesce(F.col("component.node"), F.col("node"))
    state = state.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), top.alias("component"), F.coalesce("component.rep", "rep").alias("class_id"), (top == F.col("node")).alias("_top"))
    state = materialise(state.where("n_links > 0"), "class-state")
    discard(classes, members, kept, found, comp)
    rows = feats.where("doc_id is not null").select("doc_id", "t", "k1", "k2").join(state, ["k1", "k2"], "left")
    rows = rows.select("doc_id", "t", "component", "class_id", "n_links", (F.col("_top") & (F.col("doc_id") == F.col("class_id"))).alias("first"))
    return rows.unionByName(feats.where("doc_id is null").select("doc_id", "t"), allowMissingColumns=True)


def ngram_links(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, class_id, n_links, kept: a row for each row.

    n_links: other documents at threshold or above; class_id: the least doc_id that links reach; kept: doc_id = class_id.
    """
    rows = linked_rows(docs, threshold, tolerance)
    out = rows.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each group of linked documents: that of the least doc_id, then text hash. Columns stay, and so do rows without a link, null doc_ids among them.

    Rows that share a doc_id go only if they are linked. Of the texts' rows only those to drop are dealt out, by (doc_id, text hash); the rows of docs meet them once.
    """
    names = docs.columns
    rows = materialise(linked_rows(docs, **options).where("component is not null").groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("m"), F.first("first").alias("first"), F.first("component").alias("component")), "linked-rows")
    # of texts with one set of shingles under the least doc_id, the first by hash stays
    stays = rows.where("first").groupBy("doc_id", "component").agg(F.min("t").alias("t")).select("doc_id", "t", F.lit(True).alias("_stays"))
    rows = rows.join(stays, ["doc_id", "t"], "left").select("doc_id", "t", "m", F.coalesce("_stays", F.lit(False)).alias("stays"))
    # a row that stays but has repeats is taken out with them, and one of them put back
    gone = materialise(rows.where("not stays or m > 1").select(F.col("doc_id").alias("_palaver_id"), F.col("t").alias("_palaver_t"), F.col("stays").alias("_palaver_back")), "linked-gone")
    this = (docs["doc_id"].cast("long") == F.col("_palaver_id")) & (text_id() == F.col("_palaver_t"))
    rest = docs.join(gone.drop("_palaver_back").hint("shuffle_hash"), this, "left_anti")
    again = docs.join(gone.where("_palaver_back"), this)
    again = again.withColumn("_palaver_n", F.row_number().over(W.partitionBy("_palaver_id", "_palaver_t").orderBy(F.lit(0)))).where("_palaver_n = 1")
    return rest.unionByName(again.select(*[F.col(f"`{n}`") for n in names]))
