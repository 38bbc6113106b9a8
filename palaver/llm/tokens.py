"""Encoding of whole texts with a public byte-level BPE of the tokenizers library.

A byte-level BPE of this kind never merges over a space that stands alone between two other characters: there the next token always
begins, with that space; nor over a line feed that stands alone, nor from a letter or digit into the punctuation after it. Texts are cut there into
pieces, on the bytes of whole batches. A piece of at most WIDE bytes is two 64-bit words and its length, compared exactly; a table of SLOTS
pieces, of a fixed number of bytes, gives the ids of those met before, and a new piece takes the place of one that wasn't met lately. Pieces that the
table doesn't hold, and longer ones, go to the library, each distinct one of a block once and many in one string: since a piece that begins with a
space holds no other, the tokens that begin with one tell them apart again.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa

from .common import blocks, mix, text_buffer, worker_of

#: Bytes of a piece in the table, places in it, and places that a piece can take.
WIDE, SLOTS, PROBES = 16, 1 << 19, 4
#: Pieces in one string for the library.
TOGETHER = 256
#: Punctuation that is cut from a letter or digit before it. None of it stands in a special token, and none opens a contraction.
TAIL = ".,;:!?*#%&$)"
_SPACE = np.zeros(256, bool)
_SPACE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20]] = True
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_TAIL = np.zeros(256, bool)
_TAIL[list(TAIL.encode())] = True
#: Lead bytes of white space beyond ASCII, and that white space.
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_WIDE_SPACE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_encoders: dict[tuple[str, bool], Encoder] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def cuts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin, in order; the end of the bytes comes last."""
    n = len(buf)
    # white space at n + 2 places, one beyond either end: nothing is cut there
    space = np.ones(n + 2, bool)
    space[1:-1] = _SPACE[buf]
    lead = np.flatnonzero(_LEAD[buf])
    for s in _WIDE_SPACE if len(lead) else ():
        at = lead[buf[lead] == s[0]]
        at = at[at + len(s) <= n]
        for k in range(1, len(s)):
            at = at[buf[at + k] == s[k]]
        for k in range(len(s)):
            space[at + k + 1] = True
    # a character at the edge of a text has no neighbour there
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    alone = ~space[:-2] & ~space[2:] & ~edge[:-1] & ~edge[1:]
    at = np.flatnonzero(alone & (buf == 0x20))
    feed = np.flatnonzero(alone & (buf == 0x0A))
    tail = np.flatnonzero(_WORD[buf[:-1]] & _TAIL[buf[1:]]) + 1
    edge[at] = edge[feed] = edge[feed + 1] = edge[tail] = edge[n] = True
    return np.flatnonzero(edge)


class _Table:
    """Ids of pieces of at most WIDE bytes, in a fixed space."""

    def __init__(self, dtype: np.dtype, slots: int) -> None:
        self.low, self.high = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.size, self.n, self.met = np.zeros(slots, np.uint8), np.zeros(slots, np.uint8), np.zeros(slots, bool)
        self.ids = np.zeros((slots, WIDE), dtype)
        self.slots = slots

    def places(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return ((keys >> np.uint64(20)).astype(np.int64) + probe) % self.slots

    def find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The place of each piece, -1 where the table has it not."""
        out = np.full(len(keys), -1)
        left = np.arange(len(keys))
        for p in range(PROBES):
            at = self.places(keys[left], p)
            same = (self.low[at] == low[left]) & (self.high[at] == high[left]) & (self.size[at] == size[left])
            out[left[same]] = at[same]
            left = left[~same]
        self.met[out[out >= 0]] = True
        return out

    def put(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, keys: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Distinct pieces that aren't in the table, with n ids each, one after the other."""
        begin = np.cumsum(n) - n
        left = np.flatnonzero(n <= WIDE)
        for last in (False, True):
            for p in range(PROBES):
                at = self.places(keys[left], p)
                free = np.flatnonzero((self.size[at] == 0) | ~self.met[at] | last)
                _, one = np.unique(at[free], return_index=True)
                chosen = free[one]
                at, k = at[chosen], left[chosen]
                self.low[at], self.high[at], self.size[at], self.n[at], self.met[at] = low[k], high[k], size[k], n[k], True
                column = np.arange(WIDE)
                inside = column < n[k][:, None]
                self.ids[at] = np.where(inside, ids[np.where(inside, begin[k][:, None] + column, 0)], 0)
                left = np.delete(left, chosen)
                if not len(left):
                    break
            if not len(left):
                break
            # a second chance has been given: what isn't met from here on may go
            for p in range(PROBES):
                self.met[self.places(keys[left], p)] = False


def _ragged(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... n[0] of them, then the same for the next."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Encoder:
    """literal: strings of special tokens in a text are ordinary text; else they are those tokens, as the library has it by default."""

    def __init__(self, path: str, literal: bool = False, slots: int = SLOTS):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = literal
        self.vocabulary = self.library.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        words = self.library.get_vocab()
        self.opens = np.zeros(max(words.values(), default=0) + 1, bool)  # tokens that begin with a space
        self.opens[[i for t, i in words.items() if t.startswith("Ġ")]] = True
        self.table = _Table(self.dtype, slots)

    def _plain(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of strings, one by one."""
        every = [e.ids for e in self.library.encode_batch_fast(some, add_special_tokens=False)]
        sizes = np.fromiter(map(len, every), np.int64, len(every))
        return np.fromiter(chain.from_iterable(every), np.uint32, int(sizes.sum())), sizes

    def _together(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of strings that begin with a space and hold no other."""
        ids, _ = self._plain(["".join(some[b : b + TOGETHER]) for b in range(0, len(some), TOGETHER)])
        at = np.flatnonzero(self.opens[ids])
        if len(at) == len(some) and (not len(at) or at[0] == 0):
            return ids, np.diff(np.append(at, len(ids)))
        return self._plain(some)  # a special token among them took its space, or the like

    def _ask(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after the other, and how many each has."""
        some = [p.decode() for p in pieces]
        inner = np.array([len(p) > 1 and p[0] == " " and p.find(" ", 1) < 0 for p in some], bool)
        parts = [(np.flatnonzero(inner), self._together), (np.flatnonzero(~inner), self._plain)]
        n = np.zeros(len(some), np.int64)
        found = []
        for which, by in parts:
            ids, size = by([some[k] for k in which]) if len(which) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            n[which] = size
            found.append((which, ids, size))
        begin = np.cumsum(n) - n
        out = np.zeros(int(n.sum()), np.uint32)
        for which, ids, size in found:
            out[_ragged(begin[which], size)] = ids
        return out, n

    def _pieces(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces of a block, one after the other, and how many each has."""
        size = ends - starts
        padded = np.zeros(len(buf) + 16, np.uint8)
        padded[: len(buf)] = buf
        eight = np.ndarray(len(buf) + 9, "<u8", padded, strides=(1,))  # the eight bytes from every byte on
        short = size <= WIDE
        at, width = starts[short], size[short]
        low = eight[at] & _MASK[np.minimum(width, 8)]
        high = np.where(width > 8, eight[np.minimum(at + 8, len(buf))] & _MASK[np.maximum(width - 8, 0)], np.uint64(0))
        keys = mix(low + mix(high + (width.astype(np.uint64) << np.uint64(56))))
        place = np.full(len(starts), -1)
        place[short] = self.table.find(low, high, width, keys)
        n = np.zeros(len(starts), np.int64)
        hit = place >= 0
        n[hit] = self.table.n[place[hit]]

        new = np.flatnonzero(place[short] < 0)
        _, first, which = np.unique(keys[new], return_index=True, return_inverse=True)
        first = new[first]
        same = (low[new] == low[first][which]) & (high[new] == high[first][which]) & (width[new] == width[first][which])
        where = np.flatnonzero(short)
        # pieces beyond the table's width, and of one key with another one, are told apart by their bytes
        other = np.concatenate([np.flatnonzero(~short), where[new[~same]]])
        line = buf.tobytes()
        names: dict[bytes, int] = {}
        of_other = np.fromiter((names.setdefault(line[a:b], len(names)) for a, b in zip(starts[other].tolist(), ends[other].tolist(), strict=True)), np.int64, len(other))
        asked = [line[a : a + b] for a, b in zip(at[first].tolist(), width[first].tolist(), strict=True)]
        ids, count = self._ask(asked + list(names))
        fresh = count[: len(first)]
        number = np.full(len(starts), -1)  # which of those asked a piece is
        number[where[new[same]]] = which[same]
        number[other] = len(first) + of_other
        miss = np.flatnonzero(~hit)
        n[miss] = count[number[miss]]

        begin = np.cumsum(n) - n
        out = np.zeros(int(n.sum()), np.uint32)
        flat = self.table.ids.reshape(-1)
        out[_ragged(begin[hit], n[hit])] = flat[_ragged(place[hit] * WIDE, n[hit])]
        out[_ragged(begin[miss], n[miss])] = ids[_ragged((np.cumsum(count) - count)[number[miss]], n[miss])]
        self.table.put(low[first], high[first], width[first], keys[first], ids, fresh)
        return out, n

    def encode_buffer(self, buf: np.ndarray, offsets: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other (unsigned 32-bit), each followed by `end` if given, and offsets (n + 1). The texts are UTF-8 in buf."""
        found, sizes = [], []
        for _, _, part, at in blocks(buf, offsets):
            edge = cuts(part, at) if len(part) else np.zeros(1, np.int64)
            flat, n = self._pieces(part, edge[:-1], edge[1:])
            upto = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(edge, at)]
            if end is not None:
                flat = np.insert(flat, upto[1:], np.uint32(end))
                upto = upto + np.arange(len(upto))
            found.append(flat)
            sizes.append(np.diff(upto))
        every = np.concatenate([[0], *(np.cumsum(s) for s in sizes)]) if len(sizes) < 2 else np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return (np.concatenate(found) if found else np.zeros(0, np.uint32)), every.astype(np.int64)

    def encode(self, texts: Sequence[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_buffer(*text_buffer(pa.array(texts, pa.large_string())), end)


def encoder(path: str, literal: bool = False) -> Encoder:
    """One for each process, until another operator needs the process."""
    worker_of("tokens", _encoders.clear)
    if (path, literal) not in _encoders:
        _encoders[path, literal] = Encoder(path, literal)
    return _encoders[path, literal]
