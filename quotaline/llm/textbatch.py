"""Texts of an Arrow batch as byte arrays: words, their hashes, and results kept per distinct word.

A batch is handled in slices of a few MB of text, so memory follows the slice (or the longest single text), not the
partition. Words are told apart by a 64-bit hash; among ten million different words two share one with a chance of
about three in a million.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
#: For operators that make many numbers of every word.
SMALL_SLICE_BYTES = 1 << 20
#: Distinct words whose results a Python worker keeps; beyond it, it starts anew before the next slice.
KEPT_WORDS = 800_000

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SEED = np.random.default_rng(20_240_611)
_BYTE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64, kept for the next slice."""
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers[key][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all others."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _trimmer() -> Callable[[], object]:
    """The C library's call that gives freed memory back, where there is one."""
    try:
        trim = ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda: None
    return lambda: trim(0)


_trim = _trimmer()


@dataclass
class Texts:
    """Some rows of a batch: ``first`` is the first one's place; ``offsets`` bound their bytes in ``data``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lowered(self) -> Texts:
        """With A-Z as a-z."""
        table = np.arange(256, dtype=np.uint8)
        table[65:91] += 32
        return Texts(self.first, table[self.data], self.offsets)

    def text(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Texts]:
    """The column's texts in slices of at most ``most`` bytes, or one text; a null is an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, at, data = column.buffers()
    n = len(column)
    if not n:
        return
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    k = 0
    while k < n:
        end = max(k + 1, int(np.searchsorted(at, at[k] + most, side="right")) - 1)
        yield Texts(k, data[at[k] : at[end]], at[k : end + 1] - at[k])
        k = end
    pa.default_memory_pool().release_unused()  # of batches gone by
    _trim()


@dataclass
class Pieces:
    """Byte ranges of a slice, in order, each within one text (``doc``: its place in the slice)."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def per_doc(self, n: int) -> np.ndarray:
        return np.bincount(self.doc, minlength=n)


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _edges(texts: Texts) -> np.ndarray:
    """True at the first byte of every text, and once at the end."""
    edge = np.zeros(len(texts.data) + 1, bool)
    edge[texts.offsets] = True
    return edge


def words(texts: Texts) -> Pieces:
    """Runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return."""
    solid = np.zeros(len(texts.data) + 2, bool)
    solid[1:-1] = ~_SPACE[texts.data]
    edge = _edges(texts)
    start = np.flatnonzero(solid[1:] & (~solid[:-1] | edge))
    end = np.flatnonzero(solid[:-1] & (~solid[1:] | edge))
    return Pieces(start, end, np.searchsorted(texts.offsets, start, side="right") - 1)


def chunks(texts: Texts) -> Pieces:
    """Every text cut before each run of white space that follows a solid character; nothing is left out.

    A byte-level tokenizer's pattern never joins characters across such a cut. Places where the character before is
    beyond ASCII and may be white space of Unicode are not cut.
    """
    data = texts.data
    edge = _edges(texts)
    if not len(data):
        return Pieces(*(np.zeros(0, np.int64),) * 3)
    space = _SPACE[data]
    cut = edge[:-1].copy()
    cut[1:] |= space[1:] & ~space[:-1]
    wide = np.flatnonzero(cut & ~edge[:-1])
    wide = wide[data[wide - 1] >= 0x80]
    two, three = data[wide - 2], data[np.maximum(wide - 3, 0)]
    doubtful = (two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3) & ((two == 0x9A) | (two == 0x80) | (two == 0x81)))
    cut[wide[doubtful]] = False
    start = np.flatnonzero(cut)
    return Pieces(start, np.append(start[1:], len(data)), np.searchsorted(texts.offsets, start, side="right") - 1)


def hashes(texts: Texts, pieces: Pieces) -> np.ndarray:
    """A 64-bit hash of every piece's bytes; equal bytes have equal hashes in every process. Never 0."""
    n = len(texts.data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[texts.data] * _power(_STEP, n), out=total[1:])
    value = (total[pieces.end] - total[pieces.start]) * _power(_BACK, n + 1)[pieces.start]
    return np.maximum(mix(value + (pieces.end - pieces.start).astype(np.uint64)), _U(1))


class Kept:
    """Numbers of distinct words: a hash table of arrays, looked up and filled a whole slice at a time.

    A worker keeps the words of one operator; when the next one starts, they go.
    """

    _latest: list[tuple[Kept, Callable[[], None]]] = []

    def __init__(self, most: int = KEPT_WORDS):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.size, self.bits = 0, 20
        self.keys, self.place = np.zeros(1 << 20, np.uint64), np.zeros(1 << 20, np.int32)

    def __len__(self) -> int:
        return self.size

    def _find(self, h: np.ndarray) -> np.ndarray:
        found, left = np.full(len(h), -1, np.int32), np.arange(len(h))
        slot = (h >> _U(64 - self.bits)).astype(np.int64)
        while len(left):
            key = self.keys[slot]
            hit = key == h[left]
            found[left[hit]] = self.place[slot[hit]]
            go = ~hit & (key != 0)
            left, slot = left[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return found

    def _put(self, h: np.ndarray, place: np.ndarray) -> None:
        slot = (h >> _U(64 - self.bits)).astype(np.int64)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            here = free & (self.keys[slot] == h)
            self.place[slot[here]] = place[here]
            h, place, slot = h[~here], place[~here], (slot[~here] + 1) & ((1 << self.bits) - 1)

    def _add(self, h: np.ndarray) -> None:
        if self.size + len(h) > 0.5 * len(self.keys):
            used = self.keys != 0
            old, place = self.keys[used], self.place[used]
            while self.size + len(h) > 0.4 * (1 << self.bits):
                self.bits += 1
            self.keys, self.place = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._put(old, place)
        self._put(h, np.arange(self.size, self.size + len(h), dtype=np.int32))
        self.size += len(h)

    def numbers(self, texts: Texts, pieces: Pieces, make: Callable[[list[bytes]], None], reset: Callable[[], None], forget: Callable[[], None] | None = None) -> np.ndarray:
        """Each piece's number; ``make`` gets the new pieces' bytes, in order of their numbers, ``reset`` drops all.

        ``forget`` (if not given, ``reset``) is called once another operator's words are kept.
        """
        if Kept._latest and Kept._latest[0][0] is not self:
            other, forget_other = Kept._latest[0]
            other.clear()
            forget_other()
        Kept._latest[:] = [(self, forget or reset)]
        if self.size > self.most:
            self.clear()
            reset()

        def fresh(at: np.ndarray) -> None:
            data = texts.data.tobytes()
            make([data[a:b] for a, b in zip(pieces.start[at].tolist(), pieces.end[at].tolist())])

        return self.placed(hashes(texts, pieces), fresh)

    def placed(self, h: np.ndarray, make: Callable[[np.ndarray], None]) -> np.ndarray:
        """The number of each hash; ``make`` gets a place of every new one, in order of their numbers."""
        found = self._find(h)
        if (new := np.flatnonzero(found < 0)).size:
            fresh, first = np.unique(h[new], return_index=True)
            make(new[first])
            self._add(fresh)
            found[new] = self._find(h[new])
        return found


class Lists:
    """Lists of numbers one after another, grown at the end; ``take`` strings together the chosen ones."""

    def __init__(self, dtype):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0
        self.begin, self.length, self.rows = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    @staticmethod
    def _room(array: np.ndarray, need: int) -> np.ndarray:
        return array if need <= len(array) else np.concatenate([array, np.zeros(max(need, 2 * len(array)) - len(array), array.dtype)])

    def extend(self, flat: np.ndarray, length: np.ndarray) -> None:
        self.flat = self._room(self.flat, self.used + len(flat))
        self.flat[self.used : self.used + len(flat)] = flat
        rows = self.rows + len(length)
        self.begin, self.length = self._room(self.begin, rows), self._room(self.length, rows)
        self.begin[self.rows : rows] = self.used + np.cumsum(length) - length
        self.length[self.rows : rows] = length
        self.used, self.rows = self.used + len(flat), rows

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen lists strung together, and the length of each."""
        return strung(self.flat, self.begin[which], self.length[which])


def strung(flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    before = np.cumsum(length) - length
    return flat[np.repeat(begin - before, length) + np.arange(int(length.sum()))], length


def bounds(length: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` texts' share of strung lists begins, and the end."""
    out = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(doc, weights=length, minlength=n).astype(np.int64), out=out[1:])
    return out
