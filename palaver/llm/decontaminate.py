"""Benchmark decontamination by template canonicalisation.

Words are cut at white space and stripped of ASCII punctuation at their edges. A word that begins with a digit becomes the placeholder for a number, a
unit after a number the one for a unit, and a word with a capital first letter (and not all in capitals) the one for a name; other words stand for themselves
in lower case. WINDOW consecutive words of a benchmark item are a template window; windows with fewer than LITERAL words that stand for themselves are
too general and don't count. Beside them go the plain windows, in lower case without placeholders, which see copies whose capitals were changed.

Windows of documents are joined with windows of items by their hashes. Only those that a bitmap of FILTER_BITS bits, made of all items' windows and of a fixed size,
leaves are shuffled, with the words they hold. Hits of an item in a document that lie on one diagonal (the same shift between positions) are aligned. Plain hits are
word for word and count as they are. The slots of template hits are checked, stretch by stretch of adjoining windows: each value of a slot in the item must stand
for one value in the document, so that a re-parameterised question passes and a chance agreement of form does not. Slots at odds with the others take the windows
around them out of a stretch; if they are no fewer than the repeated values that agree, the stretch is chance and none of its template hits count. Of stretches
that contradict each other, those that agree with the longest count. A document is contaminated by an item if what counts covers COVER of the item's words or RUN
consecutive ones.

Nothing that grows with the documents or the benchmark is collected or broadcast: hits are grouped by document, and a task holds one document's hits.

Defined results: null and empty texts are clean; items of fewer than LEAST words are found only as the whole text of a document (the same words), items without a word
never; items of fewer than WINDOW words have one window of all their words; null item ids are kept as null in the lists; equal rows give equal rows, and rows
with a null doc_id are judged like others; texts are read whole. Columns of docs are kept; one named like a result gives way.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, blocks, discard, mapped, materialise, mix, parts, span_hash, text_buffer, word_spans
from .ngram_join import grouped

WINDOW, LEAST, LITERAL = 8, 5, 3
COVER, RUN = 0.5, 13
#: Bits of the filter before the join: 4 MB, whatever the benchmark's size.
FILTER_BITS = 25
ITEMS = "item_id long, item long, size int, n int, plain boolean, hash long, p int, words binary, slots binary"
HITS = "row long, doc_id long, t long, n int, plain boolean, hash long, d int, words binary"
FOUND = "row long, doc_id long, t long, item_ids array<long>, coverage double"
# Units of measure, money and time.
UNITS = "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g gram grams kg kilogram kilograms lb lbs pound pounds oz ounce ounces ton tons tonne tonnes ml l liter liters litre litres gallon gallons pint pints s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur gbp percent degree degrees mph kmh km/h w kw kwh v a hz khz mhz ghz kb mb gb tb".split()

NUMBER, UNIT, NAME = (np.uint64(x) for x in (0xA11CE0001, 0xA11CE0002, 0xA11CE0003))
_MULT = np.uint64(0x9E3779B97F4A7C15)
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z and the two-byte capitals U+00C0 to U+00DE in lower case."""
    out = LOWER[buf]
    if len(buf) > 1:
        at = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
        out[at] += 0x20
    return out


def _hash_of(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    at = np.concatenate([[0], np.cumsum([len(w) for w in raw])])
    return span_hash(np.frombuffer(b"".join(raw), np.uint8), at[:-1], at[1:])


_UNIT_HASH = np.sort(_hash_of(UNITS))


@dataclass
class Words:
    literal: np.ndarray  # hash of each word in lower case
    template: np.ndarray  # the same, or its placeholder
    first: np.ndarray  # where each text's words begin (n + 1)


def canonical(buf: np.ndarray, offsets: np.ndarray) -> Words:
    starts, ends, _ = word_spans(buf, offsets)
    # strip punctuation: the first and last alphanumeric byte of each word
    upto = np.concatenate([[0], np.cumsum(_ALNUM[buf])])
    some = upto[ends] > upto[starts]
    starts, ends = starts[some], ends[some]
    where = np.flatnonzero(_ALNUM[buf])
    if len(starts):
        starts, ends = where[upto[starts]], where[upto[ends] - 1] + 1
    low = lowered(buf)
    literal = span_hash(low, starts, ends)
    head = buf[starts]
    number = (head >= 48) & (head < 58)
    changed = low != buf
    capitals = np.concatenate([[0], np.cumsum(changed)])
    # the first letter's last byte is where a two-byte capital differs
    width = np.where(head == 0xC3, 2, 1)
    capital = capitals[np.minimum(starts + width, ends)] > capitals[starts]
    more = capitals[ends] - capitals[np.minimum(starts + width, ends)]
    name = capital & ~((more > 0) & (more >= (ends - starts - width) / 2))
    after = np.concatenate([[False], number[:-1]])
    place = np.minimum(np.searchsorted(_UNIT_HASH, literal), len(_UNIT_HASH) - 1)
    unit = after & (_UNIT_HASH[place] == literal)
    template = literal.copy()
    template[name] = NAME
    template[unit] = UNIT
    template[number] = NUMBER
    return Words(literal, template, np.searchsorted(starts, offsets))


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words, wherever texts begin."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        out = mix(out * _MULT + words[k : k + len(out)])
    return out


def item_windows(benchmark: DataFrame) -> DataFrame:
    """benchmark (item_id, text, ...) -> ITEMS: a row for each window of each item; words: its words' hashes, slots: which of them are slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            buf, offsets = text_buffer(batch.column(1))
            ids = batch.column(0).to_pylist()
            for first, end, part, at in blocks(buf, offsets):
                w = canonical(part, at)
                rows: list[tuple] = []
                for k in range(end - first):
                    a, b = int(w.first[k]), int(w.first[k + 1])
                    number += 1
                    n = min(WINDOW, b - a)
                    if not n:
                        continue
                    own, slot = w.literal[a:b], w.template[a:b] != w.literal[a:b]
                    enough = np.convolve(~slot, np.ones(n, int), "valid") >= LITERAL
                    for plain, hashes, use in ((True, windows(own, n), np.ones(b - a - n + 1, bool)), (False, windows(w.template[a:b], n), enough & (b - a >= LEAST))):
                        for p in np.flatnonzero(use).tolist():
                            rows.append((ids[first + k], number, b - a, n, plain, int(hashes[p : p + 1].view(np.int64)[0]), p, own[p : p + n].tobytes(), slot[p : p + n].tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ITEM_TYPES, strict=True)], _names(ITEMS))

    return mapped(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")), "decontaminate", run, ITEMS)


_ITEM_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _filter(items: DataFrame) -> np.ndarray:
    """A bit for each value of the first FILTER_BITS bits of a hash: whether an item's window has it. At most 2^FILTER_BITS / 32 rows come here."""
    at = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    rows = items.select(F.shiftrightunsigned(at, 5).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - FILTER_BITS}) & 31 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    out = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    out[[r["word"] for r in rows]] = [r["bits"] for r in rows]
    return np.unpackbits(out.astype("<u4").view(np.uint8), bitorder="little")


def candidates(docs: DataFrame, sizes: list[int], bits: bytes) -> DataFrame:
    """docs (doc_id, t, text) -> HITS: windows of documents that the filter leaves; words: the hashes of a template window's words."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quick = np.frombuffer(sent.value, np.uint8)
        shift = np.uint64(64 - FILTER_BITS)
        row = TaskContext.get().partitionId() << 32
        for batch in batches:
            buf, offsets = text_buffer(batch.column(2))
            for first, end, part, at in blocks(buf, offsets):
                w = canonical(part, at)
                owner = np.repeat(np.arange(end - first), np.diff(w.first))
                whole = np.diff(w.first)
                for n in sizes:
                    for words, plain in ((w.literal, True), (w.template, False)):
                        if not plain and n < LEAST:
                            continue
                        h = windows(words, n)
                        found = np.flatnonzero(quick[(h >> shift).astype(np.int64) >> 3] >> ((h >> shift).astype(np.int64) & 7).astype(np.uint8) & 1)
                        found = found[owner[found] == owner[found + n - 1]]
                        if n < LEAST:
                            found = found[whole[owner[found]] == n]
                        if not len(found):
                            continue
                        doc = owner[found]
                        held = [w.literal[x : x + n].tobytes() for x in found.tolist()] if not plain else [None] * len(found)
                        take = pa.array(first + doc)
                        columns = [pa.array(row + first + doc), batch.column(0).take(take), batch.column(1).take(take), pa.array(np.full(len(found), n, np.int32)), pa.array(np.full(len(found), plain)), pa.array(h[found].view(np.int64)), pa.array((found - w.first[doc]).astype(np.int32)), pa.array(held, pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, _names(HITS))
            row += batch.num_rows

    return mapped(docs, "decontaminate", run, HITS)


def agreeing(item: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, int]:
    """Which slots follow the mapping of the item's values that most of them follow, and how many of these repeat a pair. Ties: the first pair."""
    pairs = list(zip(item.tolist(), doc.tolist(), strict=True))
    there: dict[int, int] = {}
    for (a, b), _ in Counter(pairs).most_common():
        there.setdefault(a, b)
    agree = np.array([there[a] == b for a, b in pairs], bool)
    return agree, int(agree.sum()) - len(there)


def consistent(item: np.ndarray, doc: np.ndarray) -> bool:
    """Whether each value of a slot in the item stands for one value in the document."""
    return bool(agreeing(item, doc)[0].all())


def _marked(size: int, spans: list[tuple[int, int]]) -> np.ndarray:
    mark = np.zeros(size, bool)
    for p, n in spans:
        mark[p : p + n] = True
    return mark


def _runs(mark: np.ndarray) -> list[tuple[int, int]]:
    step = np.diff(np.concatenate([[0], mark.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))


def templates(spans: list[tuple[int, int]], slot: np.ndarray, item: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The words of an item that consistent template hits of one diagonal cover. spans: position, window; slot: which of its words are slots; item, doc: values."""
    mark = _marked(len(slot), spans)
    at = np.flatnonzero(mark & slot)
    if consistent(item[at], doc[at]):
        return mark
    kept: list[tuple[int, int]] = []
    for a, b in _runs(mark):
        at = a + np.flatnonzero(slot[a:b])
        agree, repeats = agreeing(item[at], doc[at])
        odd = at[~agree]
        if not len(odd) or repeats > len(odd):
            here = [(p, n) for p, n in spans if a <= p < b and not ((odd >= p) & (odd < p + n)).any()]
            kept += _runs(_marked(len(slot), here))
    out = np.zeros(len(slot), bool)
    for a, b in sorted(kept, key=lambda x: (x[0] - x[1], x[0])):
        more = out.copy()
        more[a:b] = True
        at = np.flatnonzero(more & slot)
        out = more if consistent(item[at], doc[at]) else out
    return out


def judge(size: int, hits: list[tuple[int, int, int, bool, bytes, bytes, bytes | None]]) -> float | None:
    """hits of one item of `size` words in one document: (position in the item, in the document, window, plain, the item's words, its slots, the document's words).

    The share of the item's words that is covered, None if it is too little.
    """
    lines: dict[int, tuple[list[tuple], list[tuple]]] = {}
    for p, d, n, plain, *held in hits:
        lines.setdefault(d - p, ([], []))[plain].append((p, n, *held))
    covered = np.zeros(size, bool)
    for slotted, plain in lines.values():
        covered |= _marked(size, [x[:2] for x in plain])
        if slotted:
            own, theirs, slot = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.zeros(size, bool)
            for p, n, item, slots, doc in slotted:
                own[p : p + n], theirs[p : p + n], slot[p : p + n] = np.frombuffer(item, np.uint64), np.frombuffer(doc, np.uint64), np.frombuffer(slots, bool)
            covered |= templates(sorted({x[:2] for x in slotted}), slot, own, theirs)
    run = max((y - x for x, y in _runs(covered)), default=0)
    return float(covered.mean()) if covered.mean() >= COVER or run >= RUN else None


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> FOUND: a row for each contaminated row of docs; t: the text's hash, coverage: the most of an item that was found."""
    items = materialise(item_windows(benchmark), "bench-windows")
    sizes = sorted(r["n"] for r in items.select("n").distinct().collect())
    bits = np.packbits(_filter(items), bitorder="little").tobytes()
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_id().alias("t"), F.col("text").cast("string").alias("text"))
    hits = candidates(slim, sizes, bits).join(items.withColumnRenamed("words", "own"), ["n", "plain", "hash"])
    hits = hits.select("row", "item", "doc_id", "t", "item_id", "size", "p", "d", "n", "plain", "own", "slots", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches):
            rows: dict[int, list] = {}
            by: dict[tuple[int, int], list] = {}
            for row, item, doc_id, t, item_id, size, *hit in zip(*(c.to_pylist() for c in table.columns), strict=True):
                rows.setdefault(row, [doc_id, t, {}, 0.0])
                by.setdefault((row, item), [item_id, size, []])[2].append(tuple(hit))
            for (row, _), (item_id, size, mine) in by.items():
                if (share := judge(size, mine)) is not None:
                    rows[row][2][item_id] = True
                    rows[row][3] = max(rows[row][3], share)
            out = [(row, doc_id, t, sorted(ids, key=lambda x: (x is not None, x or 0)), most) for row, (doc_id, t, ids, most) in rows.items() if ids]
            if out:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], _names(FOUND))

    dealt = hits.repartition(parts(docs), "row").sortWithinPartitions("row")
    found = materialise(mapped(dealt, "decontaminate", run, FOUND), "contaminated")
    discard(items)
    return found


def text_id() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def _met(docs: DataFrame, found: DataFrame) -> Column:
    return docs["doc_id"].cast("long").eqNullSafe(found["_palaver_id"]) & (text_id() == found["_palaver_t"])


def mark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with item_ids (in order) and coverage (the most of an item that was found; null if clean)."""
    out = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("item_ids", "coverage")])
    found = contaminated(out, benchmark).groupBy(F.col("doc_id").alias("_palaver_id"), F.col("t").alias("_palaver_t")).agg(F.first("item_ids").alias("item_ids"), F.first("coverage").alias("coverage"))
    marked = out.join(found, _met(out, found), "left")
    return marked.select(*[F.col(f"`{c}`") for c in out.columns], F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), "coverage")


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contaminated documents: doc_id, item_ids, n_items, coverage."""
    return contaminated(docs, benchmark).select("doc_id", "item_ids", F.size("item_ids").cast("long").alias("n_items"), "coverage")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones; columns stay."""
    found = contaminated(docs, benchmark).select(F.col("doc_id").alias("_palaver_id"), F.col("t").alias("_palaver_t")).distinct()
    return docs.join(found, _met(docs, found), "left_anti")
