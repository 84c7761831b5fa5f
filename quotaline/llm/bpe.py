"""Byte-level BPE encoding and decoding over contiguous rank arrays.

A pre-token is held as two short arrays: the ids of its parts and the merge rank of every two adjacent parts. The row
is scanned for its smallest rank (leftmost on ties), that boundary is deleted and the ranks on both sides are looked up
again, until no rank is left. Rows of similar width are stacked, so one pass does this for many pre-tokens at once;
pre-tokens beyond ``WIDE`` bytes go through a heap with the same order of merges. Only distinct pieces of text are
encoded; a document's ids are strung together from theirs.

Nothing is shuffled: ids and digests are made where the text is read. A null text counts as empty and gives no ids;
repeated rows give repeated results; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quotaline.llm import textbatch as tb
from quotaline.llm.shared import ship

#: Pre-tokens up to so many bytes are rows of rank arrays.
WIDE = 64
_WIDTHS = (6, 9, 13, 20, 32, WIDE)
_NONE = np.int32(1 << 30)
#: The pattern that byte-level BPE files of this kind are used with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints, else the next one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Codec:
    """A tokenizer file of the ``tokenizers`` library: byte-level BPE without normalizer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.first = np.array([vocab[c] for c in letters], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.shift = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.shift + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        whole = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            whole[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            whole[i] = token.encode()
        self.bytes_of = tb.Lists(np.uint8)
        self.bytes_of.extend(np.frombuffer(b"".join(whole), np.uint8), np.array([len(w) for w in whole]))
        self.pattern = regex.compile(PATTERN)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.numbers, self.ids = tb.Kept(), tb.Lists(np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of pairs of ids, or a value beyond all ranks."""
        key = left.astype(np.int64) * self.shift + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def _rows(self, pieces: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, ids) of stacked rank arrays as their rows finish."""
        size = np.array([len(p) for p in pieces])
        part = self.first[np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)]
        rank = np.full((len(pieces), width), _NONE, np.int32)
        rank[:, :-1] = self.ranks(part[:, :-1], part[:, 1:])
        column = np.arange(width)
        rank[column >= (size - 1)[:, None]] = _NONE
        place = np.arange(len(pieces))
        while len(place):
            best = rank.argmin(axis=1)
            row = np.arange(len(place))
            low = rank[row, best]
            if (done := low == _NONE).any():
                yield place[done], size[done], part[done]
                go = ~done
                place, part, rank, size, best, low = place[go], part[go], rank[go], size[go], best[go], low[go]
                row = row[: len(place)]
                if not len(place):
                    return
            part[row, best] = self.merged[low]
            later = column[:-1] > best[:, None]
            part[:, :-1] = np.where(later, part[:, 1:], part[:, :-1])
            rank[:, :-1] = np.where(column[:-1] >= best[:, None], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = _NONE
            size = size - 1
            inner = best > 0
            rank[row[inner], best[inner] - 1] = self.ranks(part[row[inner], best[inner] - 1], part[row[inner], best[inner]])
            inner = best < size - 1
            rank[row[inner], best[inner]] = self.ranks(part[row[inner], best[inner]], part[row[inner], best[inner] + 1])

    def _long(self, piece: bytes) -> np.ndarray:
        """One wide pre-token: a heap of (rank, place) over a linked list of parts."""
        part = self.first[np.frombuffer(piece, np.uint8)].tolist()
        n = len(part)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        rank = self.ranks(np.array(part[:-1]), np.array(part[1:])).tolist()
        heap = [(r, i) for i, r in enumerate(rank) if r < _NONE]
        heapq.heapify(heap)
        now = [*rank, int(_NONE)]
        known: dict[tuple[int, int], int] = {}

        def look(a: int, b: int) -> int:
            if (a, b) not in known:
                known[a, b] = int(self.ranks(np.array([a]), np.array([b]))[0])
            return known[a, b]

        while heap:
            r, i = heapq.heappop(heap)
            if now[i] != r:
                continue
            j = after[i]
            part[i], after[i], now[j], part[j] = int(self.merged[r]), after[j], -1, -1
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0:
                    now[k] = look(part[k], part[after[k]]) if after[k] >= 0 else int(_NONE)
                    if now[k] < _NONE:
                        heapq.heappush(heap, (now[k], k))
        return np.array([p for p in part if p >= 0], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of some non-empty pre-tokens, and where each one's begin and how many they are."""
        length = np.array([len(p) for p in pieces], np.int64)
        count, found = np.zeros(len(pieces), np.int64), []
        low = 0
        for width in _WIDTHS:
            which = np.flatnonzero((length > low) & (length <= width))
            low = width
            if len(which):
                for place, size, part in self._rows([pieces[i] for i in which.tolist()], width):
                    count[which[place]] = size
                    found.append((which[place], size, part))
        wide = [(i, self._long(pieces[i])) for i in np.flatnonzero(length > WIDE).tolist()]
        for i, ids in wide:
            count[i] = len(ids)
        begin = np.cumsum(count) - count
        flat = np.zeros(int(count.sum()), np.int32)
        for place, size, part in found:
            inside = np.arange(part.shape[1]) < size[:, None]
            flat[(begin[place][:, None] + np.arange(part.shape[1]))[inside]] = part[inside]
        for i, ids in wide:
            flat[begin[i] : begin[i] + len(ids)] = ids
        return flat, begin, count

    def _make(self, fresh: list[bytes]) -> None:
        """Encode new chunks of text: special strings first, then the pattern's pre-tokens."""
        number: dict[str, int] = {}
        plan: list[int] = []  # pre-tokens by number, special ids as -1 - id
        sizes = []
        for chunk in fresh:
            text, n = chunk.decode("utf-8"), len(plan)
            for k, part in enumerate(self.marks.split(text) if self.marks and self.marks.search(text) else (text,)):
                if k % 2:
                    plan.append(-1 - self.special[part])
                else:
                    plan += [number.setdefault(p, len(number)) for p in self.pattern.findall(part)]
            sizes.append(len(plan) - n)
        flat, begin, count = self.encode_pieces([p.encode() for p in number])
        own = np.array([-1 - x for x in plan if x < 0], np.int32)
        plan_ = np.array(plan, np.int64)
        special = plan_ < 0
        at, size = np.zeros(len(plan_), np.int64), np.ones(len(plan_), np.int64)
        at[special] = len(flat) + np.arange(len(own))
        at[~special], size[~special] = begin[plan_[~special]], count[plan_[~special]]
        out, _ = tb.strung(np.concatenate([flat, own]), at, size)
        chunk_of = np.repeat(np.arange(len(fresh)), sizes)
        self.ids.extend(out, np.bincount(chunk_of, weights=size, minlength=len(fresh)).astype(np.int64))

    def encode(self, texts: tb.Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a slice, and the bounds of each text's."""
        cut = tb.chunks(texts)
        numbers = self.numbers.numbers(texts, cut, self._make, self.ids.clear)
        ids, length = self.ids.take(numbers)
        return ids, tb.bounds(length, cut.doc, len(texts))

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids; bytes that are no UTF-8 become replacement characters."""
        data, _ = self.bytes_of.take(ids)
        return data.tobytes().decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The file's codec, read once a worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of every row; ``path`` is the tokenizer file on every machine."""
    ship(documents.sparkSession)
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches):
        c = codec(path)
        for batch in batches:
            for texts in tb.slices(batch.column(1)):
                ids, at = c.encode(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first, len(texts)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))], ["id", "ids"])

    return documents.select(documents[id_col].alias("id"), documents[text_col].alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and ``text`` of rows with ``ids``; null ids give an empty text."""
    ship(encoded.sparkSession)
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        c = codec(path)
        for batch in batches:
            text = [c.decode(np.array(ids or [], np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["id", "text"])

    return encoded.select(encoded[id_col].alias("id"), "ids").mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every row: ``n_tokens``, digests of the ids and of the decoded text."""
    ship(documents.sparkSession)
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches):
        c = codec(path)
        for batch in batches:
            for texts in tb.slices(batch.column(1)):
                ids, at = c.encode(texts)
                little = ids.astype("<u4")
                n, ids_hex, text_hex = [], [], []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    n.append(b - a)
                    ids_hex.append(hashlib.sha256(little[a:b]).hexdigest())
                    text_hex.append(hashlib.sha256(c.decode(ids[a:b]).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first, len(texts)), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select(documents[id_col].alias("id"), documents[text_col].alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
