"""What the training-data operators share: shared scratch space, Arrow text buffers, byte-level hashing.

Text work happens on the UTF-8 buffers of Arrow batches: the bytes of many documents lie in one array,
so that numpy walks them without a Python object per document or word.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on at a time; temporaries are eight times as large.
BLOCK_BYTES = 1 << 20
#: White space as the word rules of this package have it: U+0020 and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = r"[^\x20\x09-\x0D]+"

_MULT = np.uint64(0x9E3779B97F4A7C15)


#: What operators keep in a Python worker between tasks, by operator: a function that lets go of it.
_kept: dict[str, Callable[[], None]] = {}


def worker_of(operator: str, release: Callable[[], None] | None = None) -> None:
    """Called at the start of a task: a worker that served another operator lets go of what that one kept, so that caches don't add up."""
    others = [k for k in _kept if k != operator]
    for other in others:
        _kept.pop(other)()
    if others:
        tidy()
    if release is not None:
        _kept[operator] = release


def tidy() -> None:
    """Give freed memory back to the system: Python's garbage, Arrow's pool, the C library's heaps."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mapped(df: DataFrame, operator: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema) as a task of an operator, which leaves no freed memory with its worker at the end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_of(operator)
        yield from run(batches)
        tidy()

    return df.mapInArrow(task, schema)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, or where it is unset in a local session (tests) a temporary folder. Elsewhere there is none that all would see."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = getattr(scratch_root, "local", None)
    if local is None:
        local = scratch_root.local = tempfile.mkdtemp(prefix="palaver-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
    return f"file://{local}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{scratch_root(spark)}/palaver/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete what `materialise` wrote for tables that nothing reads any more, in the shared folder only."""
    for df in tables:
        spark = df.sparkSession
        for uri in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(uri)
            if "/palaver/" in uri and path.getParent().getName() == "palaver":
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def parts(df: DataFrame, each: int = 128 << 20) -> int:
    """Partitions to deal df's rows out to: Spark's setting, and more where the files that it comes from would give a partition more than `each` bytes."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), sum(s for s in sizes if s < 1 << 60) // each)


def crc_text(column: str = "doc_id"):
    """crc32 of an id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets (n + 1) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk
        column = pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    n = len(column)
    if n == 0 or where is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(where, np.int64 if large else np.int32, n + 1, column.offset * (8 if large else 4)).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(buf: np.ndarray, offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about `size` bytes: first, end, their bytes, their offsets from 0."""
    n, first = len(offsets) - 1, 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, buf[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_spans(buf: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and where each document's words begin (n + 1). `apart` marks separator bytes."""
    inside = np.empty(len(buf) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~apart[buf]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    # a word that runs over the edge of a document is cut there
    cuts = offsets[1:-1]
    if len(cuts):
        cuts = cuts[(cuts > 0) & (cuts < len(buf))]
        cuts = np.unique(cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]) if len(cuts) else cuts
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(starts, offsets)


def _powers(n: int, cache: dict = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    if len(cache["up"]) < n + 1:
        size = 1 << (n + 1).bit_length()
        base = np.uint64(0x100000001B3)
        back = np.uint64(pow(0x100000001B3, -1, 1 << 64))
        for key, by in (("up", base), ("down", back)):
            run = np.full(size, by, np.uint64)
            run[0] = 1
            cache[key] = np.multiply.accumulate(run)
    return cache["up"], cache["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span, equal for equal bytes anywhere: a polynomial from prefix sums, then scrambled with the length."""
    up, down = _powers(len(buf))
    total = np.empty(len(buf) + 1, np.uint64)
    total[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    value = (total[ends] - total[starts]) * down[starts]
    return mix(value + (ends - starts).astype(np.uint64) * _MULT)


def window_hash(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every n consecutive words of a document, and where each document's windows begin.

    words: hashes; first: where documents begin in words (n + 1). A document of fewer words than n, but at least one, has one window of all its words.
    """
    size = np.diff(first)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    if not begin[-1]:
        return np.zeros(0, np.uint64), begin
    at = np.repeat(first[:-1] - begin[:-1], count) + np.arange(begin[-1])
    short = np.repeat(size < n, count)
    out = np.zeros(len(at), np.uint64)
    last = np.repeat(first[1:], count)
    for k in range(n):
        here = at + k
        word = words[np.minimum(here, len(words) - 1)]
        if short.any():
            word = np.where(here < last, word, np.uint64(0x1234567))
        out = mix(out * _MULT + word)
    return out, begin


def sorted_counts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and their counts."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    values = np.sort(values)
    edge = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[edge], np.diff(np.concatenate([edge, [len(values)]]))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
