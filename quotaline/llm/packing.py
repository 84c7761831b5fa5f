"""Cost-balanced packing of documents into sequences of at most ``capacity`` tokens.

A document's cost is estimated as ``linear * n + quadratic * n**2``: the second term is attention among its own
tokens. Tokenised documents gather, in the order in which they are read, until they hold ``group_tokens`` tokens; then
the group is packed. Documents longer than a sequence first fill whole sequences of their own. The others are assigned
in descending order of cost, each to the sequence of lowest cost that has room for it; if none has, it is cut and goes
to the sequences of lowest cost with any room. A group has as many sequences as its tokens fill; the tokens beyond the
last full sequence go to sequences whose lengths are powers of two, which need no padding. So no sequence is padded.

Groups are packed where their texts are read: no shuffle, no key, and memory follows ``group_tokens`` (or the longest
document). A sequence's number holds the task's partition, the group and the sequence, so a task that is run again
gives the same numbers.

Every row is a document of its own, repeated ones included; a null text counts as empty and gives only the end token.
Columns other than the id and the text are ignored. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from quotaline.llm import textbatch as tb
from quotaline.llm.bpe import byte_letters
from quotaline.llm.shared import ship

CAPACITY = 4096
GROUP_TOKENS = 4 << 20
#: Distinct parts of words whose ids a worker keeps; beyond that many it starts anew before the next slice.
KEPT_PARTS = 1 << 18
_LINE, _QUOTE = 10, 39
#: Bytes of plain runs: printable ASCII, and after ``_LATIN`` the second bytes of Latin-1's letters.
_LATIN = 0xC3
_ONE, _SECOND = np.zeros(256, bool), np.zeros(256, bool)
_ONE[[_LINE, *range(33, 127)]] = True
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False
#: What lower case adds to a byte, and to a second byte.
_LOWER, _LOWER_SECOND = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
_LOWER[65:91] = 32
_LOWER_SECOND[0x80:0x9F] = 32
#: Bytes of plain runs in lower case: lines' ends, letters, digits, others.
_KIND = np.full(256, 3, np.uint8)
_KIND[_LINE] = 0
_KIND[[*range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2


def _among(letters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[*letters.encode()]] = True
    return out


_SHORT = _among("stmd")


def parts_of(lower: np.ndarray) -> np.ndarray:
    """Where parts begin in lines of plain runs: 's 't 're 've 'm 'll 'd, runs of letters, digits, runs of others; and lines' ends."""
    kind = _KIND[lower]
    new = np.ones(len(lower), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    at = np.flatnonzero((lower == _QUOTE) & new)
    first, second = lower[at + 1], lower[np.minimum(at + 2, len(lower) - 1)]
    short = _SHORT[first]
    long = ((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
    new[at[short | long] + 1] = False
    new[at[short] + 2] = True
    new[at[long] + 3] = True
    return np.flatnonzero(new)


class WordTokens:
    """Ids of a word-level BPE file (lower case, white space dropped), kept per distinct run of solid characters.

    Runs of ASCII and Latin-1 letters are cut by the file's pattern and given to the library's model; all other runs
    go through the library whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = np.array([ord(c) for c in byte_letters()], "<u2")
        self.numbers, self.ids = tb.Kept(), tb.Lists(np.uint32)
        self.parts, self.part_ids = tb.Kept(), tb.Lists(np.uint32)

    def _part_numbers(self, lower: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(self.parts) > KEPT_PARTS:
            self._drop_parts()
        letters = self.letters[lower].tobytes().decode("utf-16-le")

        def make(new: np.ndarray) -> None:
            cut = [*map(self.model.tokenize, [letters[a:b] for a, b in zip(start[new].tolist(), end[new].tolist())])]
            self.part_ids.extend(np.array([t.id for tokens in cut for t in tokens], np.uint32), np.array([*map(len, cut)], np.int64))

        return self.parts.placed(tb.hashes(tb.Texts(0, lower, np.array([0, len(lower)])), tb.Pieces(start, end, np.zeros(len(start), np.int64))), make)

    def _make(self, fresh: list[bytes]) -> None:
        # Runs hold no line feed, so all of them are cut at once, as lines.
        runs = np.frombuffer(b"\n".join([*fresh, b""]), np.uint8)
        after = np.append(False, runs[:-1] == _LATIN)
        fit = np.where(after, _SECOND[runs], _ONE[runs] | (runs == _LATIN))
        fit[:-1] &= (runs[:-1] != ord("<")) | (runs[1:] != ord("|"))
        begin = np.append(0, np.flatnonzero(runs[:-1] == _LINE) + 1)
        plain = np.logical_and.reduceat(fit, begin)
        if not plain.all():
            keep = np.repeat(plain, np.diff(begin, append=len(runs)))
            runs, after = runs[keep], after[keep]
        lower = runs + np.where(after, _LOWER_SECOND[runs], _LOWER[runs])
        start = parts_of(lower)
        line = lower[start] == _LINE
        flat, size = self.part_ids.take(self._part_numbers(lower, start[~line], np.append(start[1:], len(lower))[~line]))
        length = np.zeros(len(fresh), np.int64)
        length[plain] = np.bincount(np.cumsum(line)[~line], weights=size, minlength=int(plain.sum()))
        if not plain.all():
            odd = [self.tokenizer.encode(run.decode("utf-8"), add_special_tokens=False).ids for run in compress(fresh, ~plain)]
            at = np.cumsum(length)[~plain]  # where the ids of the plain runs before each end
            size = np.array([len(ids) for ids in odd])
            flat = np.insert(flat, np.repeat(at, size), np.array([*chain.from_iterable(odd)], np.uint32))
            length[~plain] = size
        self.ids.extend(flat, length)

    def _drop_parts(self) -> None:
        self.parts.clear()
        self.part_ids.clear()

    def _forget(self) -> None:
        """Drop all that is kept: another operator has started."""
        self.ids.clear()
        self._drop_parts()

    def encode(self, texts: tb.Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a slice, and the bounds of each text's."""
        cut = tb.words(texts)
        ids, length = self.ids.take(self.numbers.numbers(texts, cut, self._make, self.ids.clear, self._forget))
        return ids, tb.bounds(length, cut.doc, len(texts))


_encoders: dict[str, WordTokens] = {}


def encoder(path: str) -> WordTokens:
    """The file's tokenizer, read once a worker."""
    if path not in _encoders:
        _encoders[path] = WordTokens(path)
    return _encoders[path]


def pack(lengths: np.ndarray, capacity: int = CAPACITY, linear: float = 1.0, quadratic: float = 1 / 1024) -> np.ndarray:
    """Pieces of documents of these lengths: rows of (document, start, length, sequence, offset)."""
    total = int(lengths.sum())
    room = [capacity] * (total // capacity)
    left = total % capacity
    room += [1 << k for k in reversed(range(left.bit_length())) if left >> k & 1]
    free = np.array(room, np.int64)
    size = free.copy()
    cost = np.zeros(len(free))
    cost[free < capacity] = quadratic * capacity**2 * 4  # the short ones come last
    pieces: list[tuple[int, int, int, int, int]] = []

    def put(doc: int, start: int, n: int, s: int) -> None:
        pieces.append((doc, start, n, s, int(size[s] - free[s])))
        free[s] -= n
        cost[s] += linear * n + quadratic * n * n

    unused = 0
    start = np.zeros(len(lengths), np.int64)
    for doc in np.flatnonzero(lengths >= capacity).tolist():
        while lengths[doc] - start[doc] >= capacity:
            put(doc, int(start[doc]), capacity, unused)
            start[doc] += capacity
            unused += 1
    rest = lengths - start
    for doc in np.argsort(-(linear * rest + quadratic * rest * rest), kind="stable").tolist():
        n, at = int(rest[doc]), int(start[doc])
        fits = free >= n
        if n and fits.any():
            put(doc, at, n, int(np.argmin(np.where(fits, cost, np.inf))))
            continue
        while n:
            s = int(np.argmin(np.where(free > 0, cost, np.inf)))
            part = min(n, int(free[s]))
            put(doc, at, part, s)
            n, at = n - part, at + part
    return np.array(pieces, np.int64).reshape(-1, 5)


def packed(documents: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """A row per piece: ``id_col``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` and (``with_ids``) ``ids``."""
    ship(documents.sparkSession)
    kind = documents.schema[id_col].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    def flush(keys: list[pa.Array], held: list[np.ndarray], group: int) -> Iterator[pa.RecordBatch]:
        lengths = np.array([len(h) for h in held], np.int64)
        key = pa.concat_arrays(keys)
        base = (TaskContext.get().partitionId() << 40) + (group << 20)
        pieces = pack(lengths, capacity)
        for some in (pieces[k : k + 4096] for k in range(0, len(pieces), 4096)):
            doc, start, n, sequence, offset = some.T
            parts = [held[d][a : a + m] for d, a, m in zip(doc.tolist(), start.tolist(), n.tolist())]
            crc = [zlib.crc32(p) for p in parts]
            columns = [key.take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, n, crc, lengths[doc], sequence + base, offset))]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(np.concatenate(parts).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        e, end = encoder(path), np.array([end_id], "<u4")
        keys, held, tokens, group = [], [], 0, 0
        for batch in batches:
            for texts in tb.slices(batch.column(1)):
                ids, at = e.encode(texts)
                keys.append(batch.column(0).slice(texts.first, len(texts)))
                held += [np.concatenate([ids[a:b].astype("<u4"), end]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                tokens += len(ids) + len(texts)
                if tokens >= group_tokens:
                    yield from flush(keys, held, group)
                    keys, held, tokens, group = [], [], 0, group + 1
        if held:
            yield from flush(keys, held, group)

    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return documents.select(documents[id_col].alias("id"), documents[text_col].alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
