"""Language-model scores by prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts of up to ORDER bytes, learned from the training documents: how often each byte followed each context. A byte is
coded in its longest known context; where the context has not seen it, an escape is coded (method C: d of d + T, with T observations of d
distinct bytes) and the next shorter context is asked, in which the bytes that the longer one has seen are excluded from all counts. After order 0,
the bytes not seen there are equally likely. A text is its bytes, A-Z in lower case, between START bytes (0xFF, never in UTF-8) and one END (0xFF too).

The trie of all orders follows from the counts of ORDER + 1 consecutive bytes, which every task sums up before they are shuffled. Since all
contexts of a gram nest, a byte's code length depends on its gram alone: it is worked out once for each distinct gram that occurs in any
document, level by level, with joins over the trie's tables. Scoring a document adds up its grams' code lengths.

Beside it stands the base score: unigram counts of words with add-one smoothing. Words are told apart by 64-bit hashes.

Documents are dealt into batches of at most BATCH_BYTES of text and BATCH_ROWS distinct grams and words, whichever comes first. A batch's distinct grams and words,
with counts, are what is gathered from the corpus; joined with the code lengths and the words' counts they become the batch's own look-up table, a file in the
shared folder, and a task scores a batch with that table alone. So a task's memory is bounded whatever the corpus holds, the plan is the same at every
size, and what is shuffled is a batch's distinct grams and words, never its text.

Defined results: a null or empty text is its end alone (one token). With no training document: counts are 0, base_score is n_tokens * log10(1 / 1), so 0, and each
byte costs log10(256). held_out is false for a null doc_id, which is scored like others. Repeated rows are scored (and learned) each; texts are read whole. Other
columns aren't used, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, blocks, crc_text, discard, mapped, materialise, parts, scratch, sorted_counts, span_hash, text_buffer, word_spans
from .token_store import opened, whole_file

#: Bytes of context.
ORDER = 4
EDGE = 0xFF
#: Text and distinct grams and words of a batch.
BATCH_BYTES, BATCH_ROWS = 64 << 20, 3 << 20
#: Stands for the end of a text among the words' hashes.
END_WORD = np.uint64(0x5EED0E4DF00D1234)

BATCHED = "batch long, doc_id long, held_out boolean, text string, kind int, key long, learned long"
LOOKED = "batch long, kind int, key long, value double"


def grams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER + 1 bytes that end at each byte of each text and at its end, as integers, and where texts begin among them."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    begin = offsets[:-1] + np.arange(n) * (ORDER + 1)
    line = np.full(len(buf) + n * (ORDER + 1), EDGE, np.uint8)  # each text after ORDER starts, before one end
    line[np.arange(len(buf)) + np.repeat((np.arange(n) + 1) * (ORDER + 1) - 1, size)] = buf
    wide = line.astype(np.uint64)
    packed = np.zeros(max(0, len(line) - ORDER), np.uint64)
    for k in range(ORDER + 1):
        packed = (packed << np.uint64(8)) | wide[k : k + len(packed)]
    inside = np.ones(len(packed), bool)
    for k in range(ORDER):  # grams that end in the next text's starts
        inside[begin[1:] - 1 - k] = False
    return packed[inside], offsets + np.arange(n + 1)


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words, and where texts begin among them."""
    starts, ends, first = word_spans(buf, offsets)
    return span_hash(buf, starts, ends), first


class _Bag:
    """Distinct grams (kind 0) and words (kind 1) of a batch, and how often each is in training documents."""

    def __init__(self) -> None:
        self.held: tuple[list, list] = ([], [])
        self.rows = self.compact_rows = self.size = 0

    def add(self, kind: int, keys: np.ndarray, learned: np.ndarray) -> None:
        self.held[kind].append((keys, learned))
        self.rows += len(keys)

    def compact(self) -> None:
        for some in self.held:
            if len(some) > 1:
                keys, n = (np.concatenate([x[c] for x in some]) for c in (0, 1))
                order = np.argsort(keys, kind="stable")
                keys, n = keys[order], n[order]
                edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
                some[:] = [(keys[edge], np.add.reduceat(n, edge) if len(edge) else n)]
        self.rows = self.compact_rows = sum(len(k) for some in self.held for k, _ in some)

    def full(self) -> bool:
        if self.rows - self.compact_rows > BATCH_ROWS // 3:
            self.compact()
        return self.size >= BATCH_BYTES or self.compact_rows >= BATCH_ROWS * 2 // 3

    def out(self, batch: int) -> Iterator[pa.RecordBatch]:
        self.compact()
        for kind, some in enumerate(self.held):
            for keys, n in some:
                for a in range(0, len(keys), 1 << 16):
                    k = keys[a : a + (1 << 16)]
                    none = [pa.nulls(len(k), t) for t in (pa.int64(), pa.bool_(), pa.string())]
                    yield _record([pa.array(np.full(len(k), batch)), *none, pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(n[a : a + (1 << 16)].astype(np.int64))], BATCHED)


def _record(columns: list[pa.Array], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])


def batched(docs: DataFrame) -> DataFrame:
    """docs (doc_id, held_out, text) -> BATCHED: their rows with the batch they fell into (kind is null), and the batches' distinct grams and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, bag = TaskContext.get().partitionId() << 32, _Bag()
        for batch in batches:
            buf, offsets = text_buffer(batch.column(2))
            learn = ~batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for first, end, part, at in blocks(buf, offsets):
                low = LOWER[part]
                for kind, (values, begin) in enumerate((grams(low, at), words(low, at))):
                    mine = np.repeat(learn[first:end], np.diff(begin))
                    keys, n = sorted_counts(values[mine])
                    bag.add(kind, keys, n)
                    keys, _ = sorted_counts(values[~mine])
                    bag.add(kind, keys, np.zeros(len(keys), np.int64))
                n = end - first
                bag.add(1, np.array([END_WORD]), np.array([int(learn[first:end].sum())]))
                bag.size += len(part)
                rows = [batch.column(k).slice(first, n) for k in range(3)]
                yield _record([pa.array(np.full(n, number)), *rows, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], BATCHED)
                if bag.full():
                    yield from bag.out(number)
                    number, bag = number + 1, _Bag()
        yield from bag.out(number)

    return mapped(docs.select("doc_id", "held_out", "text"), "ppm_score", run, BATCHED)


def code_lengths(table: DataFrame) -> DataFrame:
    """table: key, learned, one row for each gram that occurs -> key, cost: log10 of the probability of its last byte after the others."""
    learned = table.where("learned > 0")
    trie, nodes = {}, {}
    for k in range(ORDER, -1, -1):
        mask = (1 << 8 * (k + 1)) - 1
        source = learned if k == ORDER else trie[k + 1]
        trie[k] = source.groupBy(F.col("key").bitwiseAND(F.lit(mask).cast("long")).alias("key")).agg(F.sum("learned").alias("learned"))
        trie[k] = materialise(trie[k], f"trie{k}")
    for k in range(ORDER + 1):
        # what a context excludes in the one below: the counts there of the bytes that it has seen
        t = trie[k].withColumn("context", F.shiftright("key", 8))
        if k:
            below = trie[k - 1].select(F.col("key").alias("_b"), F.col("learned").alias("_c"))
            t = t.join(below, t["key"].bitwiseAND(F.lit((1 << 8 * k) - 1).cast("long")) == below["_b"])
        else:
            t = t.withColumn("_c", F.lit(0).cast("long"))
        nodes[k] = materialise(t.groupBy("context").agg(F.sum("learned").alias("total"), F.count(F.lit(1)).alias("distinct"), F.sum("_c").alias("out_total")), f"nodes{k}")
    scratch_tables = [*trie.values(), *nodes.values()]
    q = table.select("key", F.lit(0.0).alias("cost"), F.lit(False).alias("done"), F.lit(0).cast("long").alias("gone"), F.lit(0).cast("long").alias("gone_n"))
    for k in range(ORDER, -1, -1):
        mask = (1 << 8 * (k + 1)) - 1
        own = F.col("key").bitwiseAND(F.lit(mask).cast("long"))
        seen = trie[k].select(F.col("key").alias("_k"), F.col("learned").alias("c"))
        node = nodes[k].select(F.col("context").alias("_x"), "total", "distinct", "out_total")
        q = q.withColumn("_own", own).join(seen, F.col("_own") == F.col("_k"), "left")
        q = q.join(node, F.shiftright("_own", 8) == F.col("_x"), "left")
        total, distinct = F.col("total") - F.col("gone"), F.col("distinct") - F.col("gone_n")
        hit = ~F.col("done") & F.col("c").isNotNull()
        escape = ~F.col("done") & F.col("c").isNull() & F.col("total").isNotNull()
        step = F.when(hit, F.log10(F.col("c") / (total + distinct))).when(escape & (distinct > 0), F.log10(distinct / (total + distinct))).otherwise(0.0)
        q = q.select(
            "key",
            (F.col("cost") + step).alias("cost"),
            (F.col("done") | F.col("c").isNotNull()).alias("done"),
            F.when(escape, F.col("out_total")).otherwise(F.lit(0)).cast("long").alias("gone"),
            F.when(escape, F.col("distinct")).otherwise(F.lit(0)).cast("long").alias("gone_n"),
        )
        done, q = q, materialise(q, f"codes{k}")
        discard(*([done] if k < ORDER else []))
    discard(*scratch_tables)
    return q.select("key", (F.col("cost") + F.when(F.col("done"), 0.0).otherwise(-F.log10(F.greatest(F.lit(1), 256 - F.col("gone_n"))))).alias("cost"))


def write_tables(looked: DataFrame, folder: str) -> int:
    """looked (LOOKED) -> a file for each batch: numbers of grams and words, their keys in order, their values. Returns the number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, n = None, [], 0

        def write() -> None:
            kind, key, value = (np.concatenate([h[c] for h in held]) for c in range(3))
            key = key.view(np.uint64)
            order = np.lexsort((key, kind))
            with whole_file(f"{folder}/{now}.bin") as f:
                for x in (np.bincount(kind, minlength=2).astype("<i8"), key[order].astype("<u8"), value[order].astype("<f8")):
                    f.write(x.tobytes())

        for batch in batches:
            number, *rest = (c.to_numpy() for c in batch.columns)
            edge = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(number)]])
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if a == b:
                    continue
                if held and number[a] != now:
                    write()
                    n, held = n + 1, []
                now = int(number[a])
                held.append([x[a:b] for x in rest])
        if held:
            write()
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    dealt = looked.repartition(parts(looked), "batch").sortWithinPartitions("batch")
    return sum(r["n"] for r in mapped(dealt, "ppm_score", run, "n long").collect())


def _load(uri: str) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """A batch's grams and words, each as keys in order and values."""
    store, path = opened(uri)
    with store.open_input_file(path) as f:
        data = f.read()
    n, m = np.frombuffer(data, "<i8", 2).tolist()
    keys, values = np.frombuffer(data, "<u8", n + m, 16), np.frombuffer(data, "<f8", n + m, 16 + 8 * (n + m))
    return (keys[:n], values[:n]), (keys[n:], values[n:])


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of wanted keys, 0 where there is none."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, values[at], values.dtype.type(0))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each text's values; texts may have none."""
    total = np.zeros(len(first) - 1, np.float64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        total[some] = np.add.reduceat(values, first[:-1][some])
    return total


def score(docs: DataFrame, modulus: int = 7, rest: int = 2) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes."""
    spark = docs.sparkSession
    out = F.coalesce(F.pmod(crc_text(), F.lit(modulus)) == rest, F.lit(False))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), F.col("text").cast("string").alias("text"))
    every = materialise(batched(slim), "lm-batches")
    bag = every.where("kind is not null").select("batch", "kind", "key", "learned")
    sums = materialise(bag.groupBy("kind", "key").agg(F.sum("learned").alias("learned")), "lm-counts")
    known = sums.where("kind = 1 and learned > 0").select("key", "learned")
    r = known.agg(F.sum("learned").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.col("key") == int(END_WORD.astype(np.int64)), F.col("learned"))).alias("ends")).first()
    tokens, unit, end = r["n"] or 0, math.log10((r["n"] or 0) + r["v"] + 1), float(r["ends"] or 0)
    costs = code_lengths(sums.where("kind = 0").select("key", "learned"))
    values = costs.select(F.lit(0).alias("kind"), "key", F.col("cost").alias("value")).unionByName(known.select(F.lit(1).alias("kind"), "key", F.col("learned").cast("double").alias("value")))
    folder = scratch(spark, "lm-tables")
    write_tables(bag.select("batch", "kind", "key").join(values, ["kind", "key"]).select("batch", "kind", "key", "value"), folder)
    discard(sums, costs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table = None, None
        for batch in batches:
            number = batch.column(0).to_numpy()
            edge = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(number)]]) if len(number) else [0]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if number[a] != now:
                    now = number[a]
                    table = None
                    table = _load(f"{folder}/{now}.bin")
                yield from scored(batch.slice(a, b - a), *table)

    def scored(batch: pa.RecordBatch, costs: tuple, known: tuple) -> Iterator[pa.RecordBatch]:
        buf, offsets = text_buffer(batch.column(3))
        for first, last, part, at in blocks(buf, offsets):
            low = LOWER[part]
            g, begin = grams(low, at)
            h, word = words(low, at)
            c = _found(*known, h)
            n = np.diff(word) + 1
            base = _sums(np.log10(c + 1.0), word) + math.log10(end + 1.0) - n * unit
            seen = _sums((c > 0).astype(float), word).astype(np.int64) + (end > 0)
            integers = [pa.array(x.astype(np.int64)) for x in (n, seen, np.full(len(n), tokens))]
            yield _record([*(batch.column(k).slice(first, last - first) for k in (1, 2)), *integers, pa.array(base), pa.array(_sums(_found(*costs, g), begin)), pa.array(np.diff(at))], SCHEMA)

    return mapped(every.where("kind is null").select("batch", "doc_id", "held_out", "text"), "ppm_score", run, SCHEMA)


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
