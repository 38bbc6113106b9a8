"""Language identification by rank-order profiles (Cavnar and Trenkle).

A profile is the list of the most frequent letter n-grams (one to three letters, word edges marked by U+0020) in the order of their
frequency, ties by the n-gram's code points. A language's profile counts all labelled documents of the training folds; a document's
profile counts its own text. The out-of-place distance adds, over the document's n-grams, how far each is from its place in the language's
profile, or PROFILE where it has none. The language with the least distance is predicted, ties by name.

Counts are summed on every task before they are shuffled, and the most frequent n-grams are found in salted parts first, so a language
with most of the rows is no single task's work. The model has PROFILE n-grams for each label value.

keep_known() asks a score that comes from the training documents' own scores by language and size, so junk in known letters and languages that aren't learned go.
It scores the training documents a second time; what a short text must reach is what texts as short reach.

Defined results: text that is null or has no letter is `und` with score 0; with no labelled training document at all every text is
`und`; letters are str.isalpha() code points in lower case; all else separates words. Very long texts count whole. Equal rows give equal
rows, also those with a null doc_id, which train; other columns aren't used. lang, source and doc_id are never inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from .common import blocks, crc_text, mapped, sorted_counts, text_buffer

#: N-grams in a profile.
PROFILE = 400
LONGEST = 3
UNKNOWN = "und"
#: What keep_known() asks of a score: MARGIN of the score that all but QUANTILE of the training documents of the same language and size reach. Sizes are powers of
#: two of distinct n-grams in the profile. With fewer than PEERS such documents those of all languages count; with fewer than PEERS of these what the size below asks
#: is asked, FLOOR at the least size.
QUANTILE, MARGIN, PEERS, FLOOR = 0.01, 2 / 3, 50, 0.1
_BINS = 256

_BITS = np.uint64(21)
_fold: np.ndarray | None = None


def folded() -> np.ndarray:
    """For each code point its lower-case letter, 0 where it is no letter."""
    global _fold
    if _fold is None:
        out = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
                low = chr(c).lower()
                out[c] = ord(low[0])
        _fold = out
    return _fold


def decoded(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 and the offsets in them."""
    lead = (buf & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(lead)])
    return np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32), at[offsets]


def grams(letters: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of words with their edges, and the document of each. letters: 0 is a separator."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    # a separator after every document keeps n-grams inside it
    line = np.insert(letters, offsets[1:], 0).astype(np.uint64)
    owner = np.insert(doc, offsets[1:], np.arange(n))
    line = np.concatenate([[0], line]).astype(np.uint64)
    owner = np.concatenate([[0], owner])
    space = line == 0
    line[space] = 32
    found, owners = [line[~space]], [owner[~space]]
    packed = line
    for k in range(1, min(LONGEST, len(line))):
        packed = (packed[:-1] << _BITS) | line[k:]
        gap = np.lib.stride_tricks.sliding_window_view(space, k + 1)
        inner = gap[:, 1:-1].any(axis=1) if k > 1 else np.zeros(len(packed), bool)
        good = ~inner if k > 1 else ~(gap[:, 0] & gap[:, 1])
        found.append(packed[good])
        owners.append(owner[k:][good] if k == 1 else owner[k - 1 : len(owner) - 1][good])
    return np.concatenate(found), np.concatenate(owners)


def gram_counts(docs: DataFrame) -> DataFrame:
    """docs (text, lang) -> lang, gram, n: partial counts of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_buffer(batch.column(0))
            lang = np.array(batch.column(1).to_pylist(), object)
            for value in sorted(set(lang.tolist())):
                kept: list[tuple[np.ndarray, np.ndarray]] = []
                for first, end, part, where in blocks(buf, offsets):
                    mine = lang[first:end] == value
                    if mine.any():
                        points, at = decoded(part, where)
                        letters = folded()[points]
                        letters[~np.repeat(mine, np.diff(at))] = 0
                        kept.append(sorted_counts(grams(letters, at)[0]))
                if not kept:
                    continue
                every, n = np.concatenate([k for k, _ in kept]), np.concatenate([v for _, v in kept])
                order = np.argsort(every, kind="stable")
                every, n = every[order], n[order]
                edge = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
                if len(edge):
                    yield pa.RecordBatch.from_arrays([pa.array([value] * len(edge), pa.string()), pa.array(every[edge].view(np.int64)), pa.array(np.add.reduceat(n, edge).astype(np.int64))], ["lang", "gram", "n"])

    return mapped(docs.select("text", "lang"), "lang_id", run, "lang string, gram long, n long")


def train(docs: DataFrame) -> dict[str, list[int]]:
    """Language profiles from all rows of docs (text, lang) with a label: for each label its PROFILE most frequent n-grams."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    totals = gram_counts(rows).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = lambda *by: W.partitionBy(*by).orderBy(F.col("n").desc(), F.col("gram"))
    some = totals.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(64))).withColumn("k", F.row_number().over(best("lang", "salt"))).where(F.col("k") <= PROFILE)
    top = some.withColumn("k", F.row_number().over(best("lang"))).where(F.col("k") <= PROFILE).select("lang", "gram", "k")
    out: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r["lang"], r["k"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


def predict(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """Adds lang_pred and score to docs: 1 less the distance's share of the greatest distance, 0 for `und`. Columns of docs with these names give way."""
    return _scored(docs, profiles).drop("_palaver_size")


def _scored(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """predict() and _palaver_size: the power of two of the document's distinct n-grams, -1 for `und`."""
    frame = docs.select(*[(F.col("text").cast("string") if c == "text" else F.col(f"`{c}`")).alias(c) for c in docs.columns if c not in ("lang_pred", "score")])
    text = frame.columns.index("text")
    names = sorted(profiles)
    model = np.unique(np.array([g for p in profiles.values() for g in p], np.int64).view(np.uint64))
    places = np.full((len(model) + 1, max(1, len(names))), -1, np.int64)
    for k, name in enumerate(names):
        p = np.array(profiles[name], np.int64).view(np.uint64)
        places[np.searchsorted(model, p), k] = np.arange(len(p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_buffer(batch.column(text))
            pred: list[str] = []
            score: list[float] = []
            size: list[int] = []
            for _, _, part, where in blocks(buf, offsets):
                points, at = decoded(part, where)
                values, owner = grams(folded()[points], at)
                order = np.argsort(owner, kind="stable")
                values, first = values[order], np.searchsorted(owner[order], np.arange(len(at)))
                for a, b in zip(first[:-1], first[1:], strict=True):
                    if a == b or not names:
                        pred.append(UNKNOWN)
                        score.append(0.0)
                        size.append(-1)
                        continue
                    g, n = sorted_counts(values[a:b])
                    top = np.lexsort((g.view(np.int64), -n))[:PROFILE]
                    g = g[top]
                    hit = np.searchsorted(model, g)
                    hit[hit == len(model)] = 0
                    found = np.where((model[hit] == g)[:, None], places[hit], -1)
                    far = np.where(found < 0, PROFILE, np.abs(found - np.arange(len(g))[:, None])).sum(axis=0)
                    k = int(far.argmin())
                    pred.append(names[k])
                    score.append(1.0 - float(far[k]) / (PROFILE * len(g)))
                    size.append(len(g).bit_length() - 1)
            columns = [*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(size, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "lang_pred", "score", "_palaver_size"])

    return mapped(frame, "lang_id", run, StructType([*frame.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("_palaver_size", IntegerType())]))


def least_scores(docs: DataFrame, profiles: dict[str, list[int]]) -> dict[tuple[str, int], float]:
    """(language, size) -> the score that keep_known() asks, from all labelled rows of docs (text, lang).

    Scores are counted by language, size and bin before the shuffle; what comes to the driver has at most _BINS + 1 rows for each language and size.
    """
    rows = _scored(docs.select("text", "lang").where("lang is not null and text is not null").select("text"), profiles).where("_palaver_size >= 0")
    counts = rows.groupBy("lang_pred", F.col("_palaver_size").alias("size"), F.floor(F.col("score") * _BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    out: dict[tuple[str, int], float] = {}
    for size in range(PROFILE.bit_length()):
        peers = [r for r in counts if r["size"] == size]
        for lang in profiles:
            own = [r for r in peers if r["lang_pred"] == lang]
            group = sorted(own if sum(r["n"] for r in own) >= PEERS else peers, key=lambda r: r["bin"])
            every = sum(r["n"] for r in group)
            if every < PEERS:
                out[lang, size] = out.get((lang, size - 1), FLOOR)
                continue
            below = 0
            for r in group:
                below += r["n"]
                if below > QUANTILE * every:
                    out[lang, size] = max(FLOOR, MARGIN * r["bin"] / _BINS)
                    break
    return out


def fold(modulus: int = 3, rest: int = 1) -> Column:
    """True for documents that training must not see."""
    return F.coalesce(F.pmod(crc_text(), F.lit(modulus)) == rest, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the labelled training folds of docs and predicts all of docs: doc_id, held_out, lang_pred, score."""
    held = docs.withColumn("_palaver_held", fold())
    profiles = train(held.where("not _palaver_held"))
    return predict(held.select("doc_id", "text", F.col("_palaver_held").alias("held_out")), profiles).select("doc_id", "held_out", "lang_pred", "score")


def keep_known(docs: DataFrame) -> DataFrame:
    """docs without those in no known language: no letters, or further from every profile than training documents of that size are (see QUANTILE). Columns stay."""
    names = docs.columns
    trained = docs.where(~fold())
    profiles = train(trained)
    least = [(lang, size, score) for (lang, size), score in least_scores(trained, profiles).items()]
    floors = docs.sparkSession.createDataFrame(least, "lang_pred string, _palaver_size int, _palaver_least double")
    aside = {c: f"_palaver_in_{k}" for k, c in enumerate(names) if c in ("lang_pred", "score")}
    marked = _scored(docs.withColumnsRenamed(aside), profiles).where(F.col("lang_pred") != UNKNOWN)
    good = marked.join(F.broadcast(floors), ["lang_pred", "_palaver_size"], "left").where(F.col("score") >= F.coalesce("_palaver_least", F.lit(FLOOR)))  # nine rows a language
    return good.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in names])
