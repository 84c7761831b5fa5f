"""Word shingles of texts: sets of 64-bit hashes, their size, a digest and a minwise signature.

A-Z count as a-z; words are runs of bytes other than ASCII white space. A text's set holds the hashes of its distinct
runs of ``WIDTH`` words; a text with fewer words has its whole sequence as the only one; one without words has none.
"""

from __future__ import annotations

import numpy as np

from quotaline.llm import textbatch as tb

WIDTH = 5
#: Positions of a signature.
POSITIONS = 48
_U = np.uint64
_SEED = np.random.default_rng(20_250_117)
_MIX = _SEED.integers(1, 1 << 63, 16, dtype=np.uint64) * _U(2) + _U(1)
_A = _SEED.integers(1, 1 << 63, POSITIONS, dtype=np.uint64) * _U(2) + _U(1)
_B = _SEED.integers(0, 1 << 63, POSITIONS, dtype=np.uint64)


def hashed(texts: tb.Texts, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a slice, repeated ones too, and the text of each, in order of text."""
    low = texts.lowered()
    cut = tb.words(low)
    h, doc = tb.hashes(low, cut), cut.doc
    n_words = cut.per_doc(len(texts))
    whole = np.flatnonzero((n_words > 0) & (n_words < width))
    full = np.flatnonzero(doc[width - 1 :] == doc[: len(doc) - width + 1]) if len(doc) >= width else np.zeros(0, np.int64)
    value = np.zeros(len(full), np.uint64)
    for k in range(width):
        value += h[full + k] * _MIX[k]
    begin = np.cumsum(n_words) - n_words
    short = np.zeros(len(whole), np.uint64)
    for k in range(width - 1):
        has = n_words[whole] > k
        short[has] += h[begin[whole[has]] + k] * _MIX[k]
    short += n_words[whole].astype(np.uint64) * _MIX[15]
    out, of = np.concatenate([tb.mix(value), tb.mix(short)]), np.concatenate([doc[full], whole])
    order = np.argsort(of, kind="stable") if len(whole) else slice(None)
    return out[order], of[order]


def sets(texts: tb.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Every text's sorted set, one after another, and the bounds of each."""
    h, doc = hashed(texts)
    h = h[order := np.lexsort((h, doc))]
    doc = doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount(doc[new], minlength=len(texts)), out=at[1:])
    return h[new], at


def fingerprints(texts: tb.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every text the size of its set, a digest of it (two numbers) and its signature (0 for an empty set)."""
    h, at = sets(texts)
    n, some = np.diff(at), np.flatnonzero(np.diff(at))
    digest, signature = np.zeros((len(n), 2), np.uint64), np.zeros((len(n), POSITIONS), np.uint32)
    if len(h):
        begin = at[some]
        for k in range(2):
            digest[some, k] = np.add.reduceat(tb.mix(h ^ _MIX[k + 10]), begin)
        for k in range(POSITIONS):
            signature[some, k] = np.minimum.reduceat(((h ^ _B[k]) * _A[k]) >> _U(32), begin)
    return n, digest.view(np.int64), signature


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
