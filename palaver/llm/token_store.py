"""Token-id files: every document its own zstandard frame, with a dictionary shared by all.

A dataset is a folder in a store that pyarrow.fs can open: dictionary.bin and shards in ascending doc_id order. A shard is

    magic, u32 length of the header, header (JSON: sha256 of the dictionary, id type, end id)
    one zstandard frame for each document: its ids, little-endian, compressed with the dictionary
    index: doc_id i64[n], offset of each frame u64[n + 1], ids of each document u64[n]
    u64 offset of the index, u64 n, magic

so a short document costs two small reads by way of the index. The dictionary is trained on the ids of at most DICTIONARY_DOCS documents
of at most DICTIONARY_CHARS characters, those with the least hash of their doc_id: a bounded sample, whatever the corpus. Everything
else covers all rows. Frames go to the file as they come, and a task begins another shard after SHARD_BYTES, so a task holds one run of documents and
one shard's index, whatever the input. Shards are written under a temporary name and renamed, and hold the same bytes when a task is run again.

Defined results: a null or empty text has the end id alone; null doc_ids come first; equal rows are documents of their own, side by side, in the
order of their text; an empty table gives no shard. Other columns aren't used, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, mapped, parts, scratch, text_buffer
from .tokens import Encoder, encoder, tokenizer_path

MAGIC = b"PLVTOK02"
DICTIONARY_BYTES, DICTIONARY_DOCS, DICTIONARY_CHARS = 1 << 16, 400, 20_000
LEVEL = 3
#: Documents are encoded and read in runs of about so many bytes; frames in a shard.
RUN, SHARD_BYTES = 1 << 21, 256 << 20
NULL_ID = -(1 << 63)

MANIFEST = "path string, task int, piece int, n_docs long, n_tokens long"
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long, n_bytes long, shard int"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


@contextmanager
def whole_file(uri: str):
    """A file to write to that appears under its name at the end: a reader never sees half of it, and a task that is run again replaces it."""
    store, path = opened(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(temporary, compression=None) as f:
        yield f
    store.move(temporary, path)


def write_bytes(uri: str, data: list[bytes]) -> None:
    with whole_file(uri) as f:
        for x in data:
            f.write(x)


def read_bytes(uri: str) -> bytes:
    store, path = opened(uri)
    with store.open_input_file(path) as f:
        return f.read()


def train_dictionary(docs: DataFrame, path: str, end: int) -> bytes:
    """From a bounded sample (see above); without enough samples to train on, their plain bytes."""
    key = F.shiftrightunsigned(F.xxhash64("doc_id"), 2)
    # only about four times as many documents as are wanted come to the driver, whatever the number of partitions
    share = min(1.0, 4 * DICTIONARY_DOCS / max(1, docs.count()))
    sample = docs.where((key <= F.lit(int(share * (1 << 62)))) & (F.length("text") <= DICTIONARY_CHARS)).orderBy(key, "doc_id", "text").limit(DICTIONARY_DOCS)
    texts = [r["text"] for r in sample.select("doc_id", "text").collect()]
    enc = Encoder(path, slots=1 << 14)  # the driver's own, and small
    flat, at = enc.encode(texts, end)
    samples = [flat[a:b].astype(enc.dtype).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


class Writer:
    """Frames to a shard's file; what it holds of them is its index."""

    def __init__(self, f, raw: bytes, dtype: np.dtype, end: int):
        self.f, self.dtype = f, dtype
        self.press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw))
        header = json.dumps({"dictionary": hashlib.sha256(raw).hexdigest(), "type": dtype.str, "end": end}, sort_keys=True).encode()
        f.write(MAGIC + struct.pack("<I", len(header)) + header)
        self.at = 12 + len(header)
        self.doc_ids: list[np.ndarray] = []
        self.offsets: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, doc_ids: np.ndarray, flat: np.ndarray, at: np.ndarray) -> None:
        flat = flat.astype(self.dtype)
        frames = [self.press.compress(flat[x:y].tobytes()) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        self.offsets.append(self.at + np.cumsum([0, *map(len, frames)])[:-1])
        self.doc_ids.append(doc_ids)
        self.counts.append(np.diff(at))
        self.f.write(b"".join(frames))
        self.at += sum(map(len, frames))

    def finish(self) -> tuple[int, int]:
        """Documents and ids written."""
        doc_ids, counts = np.concatenate(self.doc_ids), np.concatenate(self.counts)
        for x in (doc_ids.astype("<i8"), np.append(np.concatenate(self.offsets), self.at).astype("<u8"), counts.astype("<u8")):
            self.f.write(x.tobytes())
        self.f.write(struct.pack("<QQ", self.at, len(doc_ids)) + MAGIC)
        return len(doc_ids), int(counts.sum())


def write_dataset(docs: DataFrame, folder: str, path: str, end: int = 2, shard: int = SHARD_BYTES) -> list[tuple[str, int, int, int]]:
    """Writes docs (doc_id, text, ...) and returns the shards in order: path, number, documents, ids."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    raw = train_dictionary(slim, path, end)
    write_bytes(f"{folder}/dictionary.bin", [raw])

    def encoded(batches: Iterator[pa.RecordBatch], enc) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            ids = batch.column(0).fill_null(NULL_ID).to_numpy()
            for a, b, part, at in blocks(*text_buffer(batch.column(1)), RUN):
                yield ids[a:b], *enc.encode_buffer(part, at, end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        task, piece = TaskContext.get().partitionId(), 0
        some = encoded(batches, enc)
        now = next(some, None)
        while now is not None:
            to = f"{folder}/shard-{task:06d}-{piece:04d}.tok"
            with whole_file(to) as f:
                out = Writer(f, raw, enc.dtype, end)
                while now is not None and out.at < shard:
                    out.add(*now)
                    now = next(some, None)
                n, tokens = out.finish()
            yield pa.RecordBatch.from_arrays([pa.array([to]), pa.array([task], pa.int32()), pa.array([piece], pa.int32()), pa.array([n], pa.int64()), pa.array([tokens], pa.int64())], ["path", "task", "piece", "n_docs", "n_tokens"])
            piece += 1

    ordered = slim.repartitionByRange(parts(docs), "doc_id", F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    written = sorted((tuple(r) for r in mapped(ordered, "tokens", run, MANIFEST).collect()), key=lambda r: r[1:3])
    return [(to, k, n, tokens) for k, (to, _, _, n, tokens) in enumerate(written)]


class Shard:
    """Random access to one shard: a file that can seek, and the dictionary. What it holds is the index."""

    def __init__(self, file, raw: bytes):
        if isinstance(file, bytes):
            file = io.BytesIO(file)
        self.file = file
        size = file.seek(0, io.SEEK_END)
        head, tail = self._bytes(0, 12), self._bytes(max(0, size - 24), size)
        if head[:8] != MAGIC or tail[-8:] != MAGIC:
            raise ValueError("not a token shard")
        self.header = json.loads(self._bytes(12, 12 + struct.unpack_from("<I", head, 8)[0]))
        if hashlib.sha256(raw).hexdigest() != self.header["dictionary"]:
            raise ValueError("the shard was written with another dictionary")
        index, docs = struct.unpack_from("<QQ", tail)
        data = self._bytes(index, size - 24)
        self.doc_ids = np.frombuffer(data, "<i8", docs)
        self.at = np.frombuffer(data, "<u8", docs + 1, 8 * docs).astype(np.int64)
        self.counts = np.frombuffer(data, "<u8", docs, 8 * (2 * docs + 1)).astype(np.int64)
        self.dtype = np.dtype(self.header["type"])
        self._open = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))

    def __len__(self) -> int:
        return len(self.doc_ids)

    def _bytes(self, begin: int, end: int) -> bytes:
        self.file.seek(begin)
        return self.file.read(end - begin)

    def _ids(self, frame: bytes, k: int) -> np.ndarray:
        return np.frombuffer(self._open.decompress(frame, max_output_size=max(1, int(self.counts[k]) * self.dtype.itemsize)), self.dtype)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document, its end id included."""
        return self._ids(self._bytes(int(self.at[k]), int(self.at[k + 1])), k)

    def runs(self, size: int = RUN) -> Iterator[tuple[int, list[np.ndarray]]]:
        """All documents in order, about `size` bytes of frames at a time: the first one's number, their ids."""
        first = 0
        while first < len(self):
            end = max(first + 1, int(np.searchsorted(self.at, self.at[first] + size, "right")) - 1)
            begin = int(self.at[first])
            data = self._bytes(begin, int(self.at[end]))
            yield first, [self._ids(data[int(self.at[k]) - begin : int(self.at[k + 1]) - begin], k) for k in range(first, end)]
            first = end


def read_dataset(spark: SparkSession, folder: str, shards: list[tuple[str, int, int, int]]) -> DataFrame:
    """One row per document, from the files: SCHEMA. start counts the ids of all documents before it."""
    start, rows = 0, []
    for path, k, _, n in shards:
        rows.append((path, k, start))
        start += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = read_bytes(f"{folder}/dictionary.bin")
        for batch in batches:
            for path, k, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, inner = opened(path)
                with store.open_input_file(inner) as f:
                    shard = Shard(f, raw)
                    before = begin
                    for first, found in shard.runs():
                        part = slice(first, first + len(found))
                        counts = np.array([len(x) for x in found], np.int64)
                        starts = before + np.cumsum(counts) - counts
                        before += int(counts.sum())
                        doc_ids = shard.doc_ids[part].astype(np.int64)
                        check = [zlib.crc32(x.astype("<u4").tobytes()) for x in found]
                        columns = [pa.array(doc_ids, mask=doc_ids == NULL_ID), pa.array(starts), pa.array(counts), pa.array(check, pa.int64()), pa.array(np.diff(shard.at[first : first + len(found) + 1])), pa.array(np.full(len(found), k, np.int32))]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "n_bytes", "shard"])

    if not rows:
        return spark.createDataFrame([], SCHEMA)
    # one shard a task, so that a lost task reads one shard again
    table = spark.createDataFrame(rows, "path string, shard int, start long").repartition(min(len(rows), 10_000), "shard")
    return mapped(table, "tokens", run, SCHEMA)


def store_tokens(docs: DataFrame, path: str | None = None, end: int = 2, folder: str | None = None) -> DataFrame:
    """Writes docs as a dataset (in the shared folder unless one is given) and reads it back: SCHEMA."""
    spark = docs.sparkSession
    path, folder = path or tokenizer_path(), folder or scratch(spark, "tokens")
    return read_dataset(spark, folder, write_dataset(docs, folder, path, end))
