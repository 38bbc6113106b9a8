"""Near-duplicate embeddings: quantised tile products with error bounds, exact where it matters.

Equal vectors are one class. The classes of one length are dealt into blocks of about TILE by a hash of their first id, and every block is one file in the shared
folder: ids, numbers of copies, 8-bit integers, scales and error bounds, and behind them the vectors in full precision. Every two blocks meet in one
tile, which reads the 8-bit parts of both. Each unit vector x is s * q + r with q in 8-bit integers; then |x.y - s_x s_y (q_x . q_y)| <= e_x + e_y + e_x e_y, where
e is the length of r, measured for each vector. The integer products of a strip come from one matrix product that is exact (sums stay below 2^24, or 2^53
in wider vectors). Only for rows with a product that may reach the threshold are the vectors read, and only those pairs are computed again in
double precision; no pair at or above the threshold is missed.

A tile gives no pairs: for each class the number of vectors it links to there, and the least class that it reaches inside the tile. Sums and
connected components over these rows give the result, so a block of thousands of copies costs rows in proportion to its vectors. A task compares
one block with up to STRIPE others. Work is the number of blocks squared; that is the price of comparing all rows whatever their angles. Tiles shuffle nothing; each reads
TILE * (dim + 32) bytes.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do vectors of different lengths with each other, nor
rows with a null vec_id (their component_id is null). Every row counts as a vector; rows that share a vec_id share a component. Vectors are divided by their largest
component first, so very large and very small ones neither overflow nor vanish. An empty table gives an empty table. Other columns aren't used, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mapped, materialise, parts, scratch
from .graph import components
from .token_store import opened, whole_file

TILE, STRIP, STRIPE = 4096, 256, 16
THRESHOLD = 0.9
LINKS = "rep long, links long, root long"


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors -> 8-bit integers, scales, lengths of the errors (rounded up)."""
    scale = np.abs(x).max(axis=1, initial=1e-300) / 127.0
    q = np.rint(x / scale[:, None])
    error = np.linalg.norm(x - scale[:, None] * q, axis=1) * (1 + 1e-9) + 1e-12
    return q.astype(np.int8), scale, error


def units(x: np.ndarray) -> np.ndarray:
    """Rows over their length; by their largest component first."""
    if not len(x):
        return x
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Block:
    """A block's file. Rows of vectors are read when they are asked for."""

    def __init__(self, uri: str, dim: int):
        self.uri, self.dim = uri, dim
        store, path = opened(uri)
        with store.open_input_file(path) as f:
            self.n = int(np.frombuffer(f.read(8), "<i8")[0])
            self.reps, self.copies = (np.frombuffer(f.read(8 * self.n), "<i8") for _ in range(2))
            self.scale, self.error = (np.frombuffer(f.read(8 * self.n), "<f8") for _ in range(2))
            self.q = np.frombuffer(f.read(self.n * dim), np.int8).reshape(-1, dim)
        self.begin = 8 + self.n * (32 + dim)

    @staticmethod
    def write(uri: str, reps: np.ndarray, copies: np.ndarray, x: np.ndarray) -> None:
        order = np.argsort(reps, kind="stable")
        x = units(x[order])
        q, scale, error = quantised(x)
        with whole_file(uri) as f:
            for part in (np.array([len(reps)], "<i8"), reps[order].astype("<i8"), copies[order].astype("<i8"), scale.astype("<f8"), error.astype("<f8"), q, x.astype("<f8")):
                f.write(np.ascontiguousarray(part).tobytes())

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        """Unit vectors of some rows, in order; rows that lie close together are read in one go."""
        out = np.empty((len(rows), self.dim))
        store, path = opened(self.uri)
        with store.open_input_file(path) as f:
            for some in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(rows) > 64) + 1) if len(rows) else []:
                first, last = int(rows[some[0]]), int(rows[some[-1]])
                f.seek(self.begin + first * self.dim * 8)
                read = np.frombuffer(f.read((last - first + 1) * self.dim * 8), "<f8").reshape(-1, self.dim)
                out[some] = read[rows[some] - first]
        return out


def possible(x: Block, y: Block, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of x, row of y) that may reach the threshold, by their quantised product and its bound."""
    exact = np.float32 if x.dim * 127 * 127 < 1 << 24 else np.float64
    right = np.ascontiguousarray(y.q.astype(exact).T)
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for a in range(0, x.n, STRIP):
        rows = slice(a, a + STRIP)
        near = (x.q[rows].astype(exact) @ right) * (x.scale[rows, None] * y.scale)
        i, j = np.nonzero(near >= threshold - 1e-9 - (x.error[rows, None] + y.error + x.error[rows, None] * y.error))
        i = i + a
        found.append((i[j > i], j[j > i]) if same else (i, j))
    i, j = (np.concatenate([f[c] for f in found]).astype(np.int32) for c in (0, 1))
    return i, j


def tile_links(x: Block, y: Block, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of x, row of y) with cosine >= threshold; in a tile of a block with itself, each pair once."""
    i, j = possible(x, y, threshold, same)
    if not len(i):
        return
    left, right = np.unique(i), np.unique(j)
    u, v = x.vectors(left), y.vectors(right)
    for b in range(0, len(i), 1 << 15):
        k, m = i[b : b + (1 << 15)], j[b : b + (1 << 15)]
        good = np.einsum("nd,nd->n", u[np.searchsorted(left, k)], v[np.searchsorted(right, m)]) >= threshold
        yield k[good], m[good]


def roots(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least reachable index of each of n nodes."""
    label = np.arange(n)
    if not pairs:
        return label
    a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def link_embeddings(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vectors (vec_id, embedding, ...) -> vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    e = F.col("embedding")
    fine = e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(e, lambda c: c != 0)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e, F.coalesce(fine, F.lit(False)).alias("fine"))
    v = v.select("vec_id", "embedding", F.when(F.col("fine"), F.xxhash64(e)).alias("h1"), F.when(F.col("fine"), F.xxhash64(F.reverse(e))).alias("h2"))
    classes = v.where("h1 is not null and vec_id is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding"))
    classes = materialise(classes.withColumn("dim", F.size("embedding")), "vector-classes")
    # a row for each length of vectors
    blocks = materialise(classes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).alias("blocks")), "vector-dims")
    folder = scratch(spark, "vector-blocks")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, n = None, [], 0

        def write() -> None:
            reps, copies, x = (np.concatenate([h[c] for h in held]) for c in range(3))
            Block.write(f"{folder}/{now[0]}-{now[1]}.blk", reps, copies, x.reshape(-1, now[0]))

        for batch in batches:
            dim, block = (batch.column(k).to_numpy() for k in range(2))
            rep, copies = (batch.column(k).fill_null(0).to_numpy() for k in (2, 3))
            real, x = copies > 0, batch.column(4)
            at, flat = x.offsets.to_numpy(), x.values.to_numpy(zero_copy_only=False)
            edge = np.concatenate([[0], np.flatnonzero((np.diff(dim) != 0) | (np.diff(block) != 0)) + 1, [len(dim)]])
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if a == b:
                    continue
                if held and now != (dim[a], block[a]):
                    write()
                    n, held = n + 1, []
                now = (int(dim[a]), int(block[a]))
                held.append((rep[a:b][real[a:b]], copies[a:b][real[a:b]], flat[at[a] : at[b]]))
        if held:
            write()
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    dealt = classes.join(F.broadcast(blocks) if blocks.count() < 1000 else blocks, "dim")
    dealt = dealt.select("dim", F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("block"), "rep", "n", F.col("embedding").cast("array<double>").alias("embedding"))
    # a row for each block, so that a block without vectors has a file too
    every = blocks.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    dealt = dealt.unionByName(every.select("dim", "block", F.lit(None).cast("long").alias("rep"), F.lit(None).cast("long").alias("n"), F.array().cast("array<double>").alias("embedding")))
    many = parts(vectors)
    mapped(dealt.repartition(many, "dim", "block").sortWithinPartitions("dim", "block"), "embed_dedup", pack, "n long").agg(F.sum("n")).collect()
    stripes = blocks.select("dim", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("i"))
    stripes = stripes.select("dim", "blocks", "i", F.explode(F.sequence(F.col("i"), F.col("blocks") - 1, F.lit(STRIPE).cast("long"))).alias("j"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, total, i, j in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = Block(f"{folder}/{d}-{i}.blk", d)
                for other in range(j, min(j + STRIPE, total)):
                    yield from _tile(x, x if other == i else Block(f"{folder}/{d}-{other}.blk", d), other == i, threshold)

    found = materialise(mapped(stripes.repartition(many, "dim", "i", "j"), "embed_dedup", compare, LINKS), "vector-links")
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    state = classes.select("h1", "h2", "rep", "n").join(sums, "rep", "left").join(comp, F.col("rep") == comp.node, "left")
    state = state.select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    state = materialise(state.where("n_links > 0"), "vector-state")
    discard(classes, blocks, found)
    out = v.select("vec_id", "h1", "h2").join(state, ["h1", "h2"], "left").select("vec_id", F.when(F.col("vec_id").isNull(), F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _tile(x: Block, y: Block, same: bool, threshold: float) -> Iterator[pa.RecordBatch]:
    shift = 0 if same else x.n
    reps = x.reps if same else np.concatenate([x.reps, y.reps])
    links = np.zeros(len(reps), np.int64)
    pairs = []
    for a, b in tile_links(x, y, threshold, same):
        np.add.at(links, a, y.copies[b])
        np.add.at(links, b + shift, x.copies[a])
        pairs.append((a, b + shift))
    hit = np.flatnonzero(links)
    if len(hit):
        order = np.argsort(reps, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        root = reps[order][roots(len(reps), [(place[a], place[b]) for a, b in pairs])][place]
        yield pa.RecordBatch.from_arrays([pa.array(reps[hit]), pa.array(links[hit]), pa.array(root[hit])], ["rep", "links", "root"])
