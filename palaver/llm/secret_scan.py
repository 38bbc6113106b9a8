"""Secret scans: an Aho-Corasick keyword prefilter, anchored regular expressions near hits, checksum validation.

One pass of an automaton over the text (ASCII letters in lower case) finds the keywords of all kinds. A kind's regular expression is
tried only where one of its keywords was found, anchored at the start that the keyword fixes; candidates that overlap an earlier match
of their kind are passed over, which gives the leftmost, non-overlapping matches of the whole text. Long runs of hexadecimal digits
have no keyword; their prefilter looks at every 32nd character, since a run of 32 or more covers one. Kinds with an embedded
checksum are reported only if it holds.

Defined results: null or empty text has no span; spans are code points, end exclusive; very long texts are scanned whole; equal rows
give equal rows, and a null doc_id a row with a null doc_id;
other columns of the input are not used, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped

# The base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
BASE = ("assign", "access", "hex")
# Kinds with a checksum. GitHub and npm tokens end in the CRC-32 of what precedes, in base 62; extended private keys (BIP 32) in four bytes of a double SHA-256, in base 58.
CHECKED = {"github": re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"), "npm": re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"), "xprv": re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])")}
KINDS = (*BASE, *CHECKED)
KEYWORDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",), "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",), "xprv": ("xprv",)}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_checked long"
_HEX_DIGITS = frozenset("0123456789abcdef")
_UPPER = {c: c + 32 for c in range(65, 91)}


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def crc_holds(body: str, check: str) -> bool:
    value = zlib.crc32(body.encode())
    digits = ""
    while value:
        value, k = divmod(value, 62)
        digits = BASE62[k] + digits
    return digits.rjust(6, "0") == check


def base58_holds(text: str) -> bool:
    value = 0
    for c in text:
        value = value * 58 + BASE58.index(c)
    if value >= 1 << 8 * 82:
        return False
    raw = value.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def _valid(kind: str, m: re.Match) -> bool:
    return base58_holds(m[0]) if kind == "xprv" else crc_holds(m[1], m[2])


def _ascii_lower(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_UPPER) if len(low := text.lower()) != len(text) else low


def scan(text: str, keywords: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all kinds, by start, then kind."""
    spans: list[tuple[int, int, str]] = []
    free = dict.fromkeys(KINDS, 0)  # where the kind's last match ended
    for last, (kind, n) in keywords.iter(_ascii_lower(text)):
        at = last - n + 1
        if at < free[kind]:
            continue
        if m := (ASSIGN if kind == "assign" else ACCESS if kind == "access" else CHECKED[kind]).match(text, at):
            if kind in BASE:
                free[kind] = m.end()
                keep = len(m[2]) >= ASSIGN_LEAST if kind == "assign" else len(m[0]) >= ACCESS_LEAST
            elif keep := _valid(kind, m):
                free[kind] = m.end()
            if keep:
                spans.append((m.start(), m.end(), kind))
    end = 0
    every = text[HEX_LEAST - 1 :: HEX_LEAST]
    if not _HEX_DIGITS.isdisjoint(every):
        for k, c in enumerate(every):
            at = k * HEX_LEAST + HEX_LEAST - 1
            if c in _HEX_DIGITS and at >= end:
                start = at
                while start > end and text[start - 1] in _HEX_DIGITS:
                    start -= 1
                end = HEX.match(text, at).end()
                if end - start >= HEX_LEAST:
                    spans.append((start, end, "hex"))
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2])))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_documents(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> SCHEMA, a row for each row. No shuffle; a document at a time is held as a string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = _automaton()
        for batch in batches:
            rows = []
            for text in batch.column(1):
                spans = scan(text.as_py() or "", keywords)
                base = [s for s in spans if s[2] in BASE]
                n = [sum(s[2] == k for s in base) for k in BASE]
                rows.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written(spans), len(spans) - len(base)))
            n_assign, n_access, n_hex, sha, every, checked = zip(*rows, strict=True) if rows else [()] * 6
            columns = [batch.column(0), pa.array(n_assign, pa.int64()), pa.array(n_access, pa.int64()), pa.array(n_hex, pa.int64()), pa.array(sha, pa.string()), pa.array(every, pa.string()), pa.array(checked, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_checked"])

    return mapped(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), "secret_scan", run, SCHEMA)
