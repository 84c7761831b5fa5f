"""An adaptive context-mixing range coder for blocks of token ids.

A block's ids are dealt to lanes, each a run of neighbouring ids with a stream of its own, and all lanes are coded in
step: one vector operation codes an id of every lane. The model is the block's: it starts anew with every block and
learns from all lanes after each step, so a decoder that has the ids so far has the same model.

Three predictions are mixed for every id:

- order 2: the id that last followed this pair of ids, and how often it was right of late;
- order 1: the id that last followed this id, and how often it was right of late;
- order 0: how often each id has been seen in the block, no id ever being impossible.

The weights of the three depend on how sure orders 1 and 2 are and whether they agree, and are learned from how often
each was the first to be right. An id's interval is its share of the mixture. All arithmetic is on integers.

Ranges are 63 bits and give off 32 bits at a time; carries are added up afterwards. A block's bytes: a header (magic,
version, ids, texts, lanes, vocabulary, CRC-32 of the ids and of all that follows), the number of ids of every text,
the number of digits of every lane, and the lanes' digits, all little-endian.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, VERSION = b"QLID", 1
HEADER = struct.Struct("<4sHHIIIIII")
LANES, LEAST_STEPS = 4096, 256
#: Bits of the weights, of the tables of orders 2 and 1, and of how sure a prediction is.
WEIGHT, TABLE2, TABLE1, SURE = 10, 18, 16, 4
_MOST = (1 << SURE) - 1
#: How a prediction's sureness changes where it was wrong (first half) and right; wrong at 1 or less, it is replaced.
_CHANGE = np.array([*((k >> 1) - k for k in range(1 << SURE)), *(int(k < _MOST) for k in range(1 << SURE))], np.int32)
_U = np.uint64
_LOW = _U((1 << 31) - 1)
_BOTTOM = _U(1 << 31)


class Damaged(ValueError):
    """A block whose checksums do not fit its bytes."""


class Model:
    """The three predictions and their weights, for ids below ``vocab``, at most 2**20."""

    def __init__(self, vocab: int, lanes: int):
        self.vocab, self.bits = vocab, min(max(19, vocab.bit_length() + 3), 21)
        self.kind = np.int32 if self.bits + WEIGHT < 31 else np.int64
        self.seen, self.fresh = np.zeros(vocab, np.int64), []
        none = vocab << SURE  # predicts an id that does not occur
        self.two, self.one = np.full(1 << TABLE2, none, np.int32), np.full(1 << TABLE1, none, np.int32)
        self.right = np.tile(np.array([1, 1, 2], np.int64), (2 << 2 * SURE, 1))
        self.outcomes = []
        self.before = np.zeros(lanes, np.uint32)
        self.last = np.zeros(lanes, np.uint32)
        self.step = 0
        self.shares()
        self.weights()

    def shares(self) -> None:
        """The bounds of every id's share of order 0."""
        if self.fresh:
            self.seen += np.bincount(np.concatenate(self.fresh), minlength=self.vocab)
            self.fresh = []
        total = int(self.seen.sum())
        upto = np.zeros(self.vocab + 1, np.int64)
        if total:
            np.cumsum(self.seen, out=upto[1:])
            upto *= (1 << self.bits) - self.vocab
            # Doubles divide exactly enough: products stay below 2**53, and quotients below a whole number are 1 / total below it.
            upto = (upto / total).astype(np.int64)
            upto += np.arange(self.vocab + 1)
        else:
            upto = np.arange(self.vocab + 1) * ((1 << self.bits) // self.vocab)
        self.upto, self.size = upto[:-1].astype(self.kind), np.diff(upto).astype(self.kind)
        self.of = None

    def who(self, at: np.ndarray) -> np.ndarray:
        """The id whose share of order 0 holds a place."""
        if self.of is None:
            size = self.size.copy()
            size[-1] += (1 << self.bits) + 1 - int(size.sum())  # the last id takes the places beyond all shares
            self.of = np.repeat(np.arange(self.vocab, dtype=np.int32), size)
        return self.of[at]

    def weights(self) -> None:
        if self.outcomes:
            self.right += np.bincount(np.concatenate(self.outcomes), minlength=self.right.size).reshape(-1, 3) << 2
            self.outcomes = []
        share = self.right * ((1 << WEIGHT) - 3) // self.right.sum(axis=1)[:, None] + 1
        self.first, self.second = share[:, 0].astype(self.kind), (share[:, 0] + share[:, 1]).astype(self.kind)

    def predict(self) -> None:
        """Places in the tables, predicted ids and the bounds of the mixture's parts, for the next id of every lane."""
        own = self.last * np.uint32(0x9E3779B1)
        self.at2 = ((own + self.before * np.uint32(0x85EBCA6B)) >> np.uint32(32 - TABLE2)).astype(np.int64)
        self.at1 = (own >> np.uint32(32 - TABLE1)).astype(np.int64)
        self.slot2, self.slot1 = self.two[self.at2], self.one[self.at1]
        self.guess2, self.guess1 = self.slot2 >> SURE, self.slot1 >> SURE
        self.sure2, self.sure1 = self.slot2 & _MOST, self.slot1 & _MOST
        self.state = ((self.sure2 << SURE + 1) + (self.sure1 << 1) + (self.guess1 == self.guess2)).astype(np.int64)
        self.end2, self.end1 = self.first[self.state], self.second[self.state]

    def learn(self, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """Take in the ids that came; ``hit1`` where order 1 was right, whatever order 2 said."""
        new = (ids << SURE) + 1
        for table, at, slot, sure, hit in ((self.two, self.at2, self.slot2, self.sure2, hit2), (self.one, self.at1, self.slot1, self.sure1, hit1)):
            case = (sure + (hit.view(np.int8) << SURE)).astype(np.int64)
            table[at] = np.where(case > 1, slot + _CHANGE[case], new)
        self.outcomes.append(self.state * 3 + 2 - (hit2.view(np.int8) << 1) - (hit1 > hit2))
        self.before, self.last = self.last, ids.view(np.uint32)
        self.fresh.append(ids)
        self.step += 1
        if self.step & 15 == 0 or self.step & (self.step - 1) == 0:
            self.shares()
            self.weights()
            self.right -= self.right >> 2
            self.right |= 1


def encoded(ids: np.ndarray, vocab: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Lanes, the number of digits of each, and all digits, of ids below ``vocab``."""
    lanes = max(1, min(LANES, len(ids) // LEAST_STEPS))
    steps = -(-len(ids) // lanes)
    grid = np.zeros(lanes * steps, np.int32)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = Model(vocab, lanes)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, 1 << 63, np.uint64)
    digits, used = np.zeros((steps + 2, lanes), np.int64), np.zeros(lanes, np.int64)
    bits, whole = model.bits, 1 << WEIGHT
    for row in grid:
        model.predict()
        hit2, hit1 = row == model.guess2, row == model.guess1
        miss2 = (~hit2).view(np.int8)
        first, begin = model.end2 << bits, model.end1 << bits
        start = first * miss2
        size = first + (begin - 2 * first) * miss2
        rest = np.flatnonzero(~(hit2 | hit1))
        own, share = row[rest], whole - model.end1[rest]
        start[rest] = begin[rest] + model.upto[own] * share
        size[rest] = model.size[own] * share
        unit = width >> _U(bits + WEIGHT)
        low += unit * start.astype(np.uint64)
        width = unit * size.astype(np.uint64)
        out = np.flatnonzero(width < _BOTTOM)
        now = low[out]
        digits[used[out], out] = (now >> _U(31)).view(np.int64)
        used[out] += 1
        low[out] = (now & _LOW) << _U(32)
        width[out] <<= _U(32)
        model.learn(row, hit2, hit1)
    digits[used, np.arange(lanes)] = ((low + _LOW) >> _U(31)).view(np.int64)
    used += 1
    for k in range(len(digits) - 1, 0, -1):
        digits[k - 1] += digits[k] >> 32
    digits = np.ascontiguousarray(digits.astype(np.uint32).T)  # without the carries, which have been added
    while (bare := (used > 0) & (digits[np.arange(lanes), used - 1] == 0)).any():  # the reader takes them as given
        used[bare] -= 1
    return lanes, used, digits[np.arange(digits.shape[1]) < used[:, None]]


def decoded(n: int, lanes: int, used: np.ndarray, flat: np.ndarray, vocab: int) -> np.ndarray:
    """The ids of a block."""
    steps = -(-n // lanes)
    digits = np.zeros((lanes, max(steps, int(used.max(initial=0))) + 4), np.uint32)
    digits[np.arange(digits.shape[1]) < used[:, None]] = flat
    ahead = (digits[:, :-1] << np.uint32(31)) | (digits[:, 1:] >> np.uint32(1))
    code = ((digits[:, 0] >> np.uint32(1)).astype(np.uint64) << _U(32)) | ahead[:, 0]
    at, width = np.ones(lanes, np.int64), np.full(lanes, 1 << 63, np.uint64)
    model = Model(vocab, lanes)
    bits, whole, top = model.bits, 1 << WEIGHT, _U((1 << model.bits + WEIGHT) - 1)
    out = np.zeros((steps, lanes), np.int32)
    for row in out:
        model.predict()
        unit = width >> _U(bits + WEIGHT)
        place = np.minimum(code // unit, top).astype(model.kind)
        first, begin = model.end2 << bits, model.end1 << bits
        miss2 = (place >= first).view(np.int8)
        start = first * miss2
        size = first + (begin - 2 * first) * miss2
        np.add(model.guess2, (model.guess1 - model.guess2) * miss2, out=row)
        rest = np.flatnonzero(place >= begin)
        base, share = begin[rest], whole - model.end1[rest]
        row[rest] = own = model.who(((place[rest] - base) / share).astype(np.int32))
        start[rest] = base + model.upto[own] * share
        size[rest] = model.size[own] * share
        code -= unit * start.astype(np.uint64)
        width = unit * size.astype(np.uint64)
        more = np.flatnonzero(width < _BOTTOM)
        here = at[more]
        code[more] = (code[more] << _U(32)) | ahead[more, here]
        at[more] = here + 1
        width[more] <<= _U(32)
        if row.max() >= vocab:
            raise Damaged("a block leads to an id outside its vocabulary")
        model.learn(row, row == model.guess2, row == model.guess1)
    return out.T.ravel()[:n]


def block(ids: np.ndarray, lengths: np.ndarray, vocab: int) -> bytes:
    """The bytes of a block of whole texts, ``lengths`` ids each."""
    if len(ids) and int(ids.max()) >= vocab:
        raise ValueError(f"an id is not below {vocab}")
    if vocab > 1 << 20:
        raise ValueError("vocabularies go up to 2**20 ids")
    lanes, used, digits = encoded(ids, vocab) if len(ids) else (0, np.zeros(0, np.int64), np.zeros(0, np.int64))
    body = b"".join(x.astype("<u4").tobytes() for x in (lengths, used, digits))
    return HEADER.pack(MAGIC, VERSION, 0, len(ids), len(lengths), lanes, vocab, zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body


def texts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A block's ids and the number of ids of every text, checked against both checksums."""
    magic, version, _, n, n_texts, lanes, vocab, crc_ids, crc_body = HEADER.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise Damaged("not a block of this format")
    if zlib.crc32(memoryview(data)[HEADER.size :]) != crc_body:
        raise Damaged("a block's bytes do not fit their checksum")
    body = np.frombuffer(data, "<u4", offset=HEADER.size)
    lengths, used = body[:n_texts].astype(np.int64), body[n_texts : n_texts + lanes].astype(np.int64)
    ids = decoded(n, lanes, used, body[n_texts + lanes :], vocab).astype("<u4") if n else np.zeros(0, "<u4")
    if zlib.crc32(ids.tobytes()) != crc_ids:
        raise Damaged("a block's ids do not fit their checksum")
    return ids, lengths
