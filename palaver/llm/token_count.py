"""Token counts of flat token files by a separator scan.

A flat file is a run of little-endian ids, every document followed by an end-of-document id; nothing says where documents begin. Files are
cut into blocks of BLOCK ids, wherever that falls. Each block is searched for the end id as one array. A document that began in an earlier
block is stitched by a prefix scan over block summaries: the running count of ends gives a document's number in its file, the running
maximum of the last end gives where it began. Only summaries, one row per block, go through that scan, file by file; the ends
themselves stay where they were found.

Defined results: ids after a file's last end are a document without end (ended is false); an empty file has no document; a document may span any number of
blocks. Writing: a null or empty text is the end id alone; equal rows are documents of their own. Strings that look
like the end token inside a text are encoded as ordinary text, so that the end id stands at ends only. Rows with a null doc_id are documents like others.
Other columns aren't used, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import blocks, mapped, materialise, parts, scratch, text_buffer
from .token_store import RUN, opened, whole_file
from .tokens import Encoder, encoder, tokenizer_path

#: Ids in a block.
BLOCK = 1 << 20
#: The byte-level BPE's own end-of-text id; no text is encoded to it here.
END = 50256

ENDS = "file string, block long, k long, position long, last boolean"


def write_flat(docs: DataFrame, folder: str, path: str, end: int = END) -> DataFrame:
    """Writes docs (doc_id, text, ...) as flat files, one for each partition, rows as they come. Returns file, k, doc_id: which document a file's k-th is.

    Nothing is shuffled. A file appears under its name only when it is whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, literal=True)
        to = f"{folder}/flat-{TaskContext.get().partitionId():06d}.bin"
        n = 0
        with whole_file(to) as f:
            for batch in batches:
                for _, _, part, at in blocks(*text_buffer(batch.column(1)), RUN):
                    f.write(enc.encode_buffer(part, at, end)[0].astype(enc.dtype).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([to] * batch.num_rows, pa.string()), pa.array(np.arange(n, n + batch.num_rows)), batch.column(0)], ["file", "k", "doc_id"])
                n += batch.num_rows

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(mapped(slim, "tokens", run, "file string, k long, doc_id long"), "flat-docs")


def files_of(folder: str) -> list[tuple[str, int]]:
    """Files of a folder and their bytes."""
    store, path = opened(folder)
    scheme = folder[: folder.index(path)] if path in folder else ""
    return sorted((f"{scheme}{x.path}", x.size) for x in store.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if x.is_file and x.path.endswith(".bin"))


def block_ends(ids: np.ndarray, end: int) -> np.ndarray:
    """Where in a block documents end."""
    return np.flatnonzero(ids == end)


def scan(spark: SparkSession, files: list[tuple[str, int]], end: int = END, dtype: str = "<u2", block: int = BLOCK) -> DataFrame:
    """files: (uri, bytes). -> file, k, start, n_tokens (its end id included), ended: one row per document."""
    width = np.dtype(dtype).itemsize
    for f, n in files:
        if n % width:
            raise ValueError(f"{f} holds half an id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, path = opened(file)
                with store.open_input_file(path) as f:
                    f.seek(b * block * width)
                    ids = np.frombuffer(f.read(min(block * width, size - b * block * width)), dtype)
                at = block_ends(ids, end) + b * block
                last = (b + 1) * block * width >= size
                if last and (not len(at) or at[-1] != size // width - 1):  # what is left after the last end
                    at = np.append(at, size // width - 1)
                    whole = np.append(np.ones(len(at) - 1, bool), False)
                else:
                    whole = np.ones(len(at), bool)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(at), pa.string()), pa.array(np.full(len(at), b)), pa.array(np.arange(len(at))), pa.array(at), pa.array(whole)], ["file", "block", "k", "position", "last"])

    table = spark.createDataFrame([(f, n) for f, n in files if n], "file string, size long")
    cut = table.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / F.lit(block * width)))).alias("block"))
    ends = materialise(mapped(cut.repartition(parts(table), "file", "block"), "token_count", run, ENDS), "ends")
    # the prefix scan over block summaries
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = ends.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.max("position").alias("top"))
    sums = sums.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.coalesce(F.max("top").over(before), F.lit(-1)).alias("carry"))
    inside = W.partitionBy("file", "block").orderBy("k")
    out = ends.join(sums, ["file", "block"]).withColumn("from", F.coalesce(F.lag("position").over(inside), F.col("carry")) + 1)
    return out.select("file", (F.col("base") + F.col("k")).alias("k"), F.col("from").alias("start"), (F.col("position") - F.col("from") + 1).alias("n_tokens"), F.col("last").alias("ended"))


def count_tokens(docs: DataFrame, path: str | None = None, folder: str | None = None, end: int = END) -> DataFrame:
    """Writes docs as flat files, counts by scanning the files alone, and names the documents: doc_id, n_tokens, ended, file, k, start."""
    spark = docs.sparkSession
    path, folder = path or tokenizer_path(), folder or scratch(spark, "flat")
    names = write_flat(docs, folder, path, end)
    counted = scan(spark, files_of(folder), end, Encoder(path, literal=True, slots=1).dtype.str)
    return names.join(counted, ["file", "k"]).select("doc_id", "n_tokens", "ended", "file", "k", "start")
