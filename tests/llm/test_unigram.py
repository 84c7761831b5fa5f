from __future__ import annotations

import random

from quotaline.llm import unigram
from quotaline.llm.queries import PIECES


def brute(v, word):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        c = word[end - 1]
        ways = [(best[-1][0] + v.unknown, best[-1][1] - (len(c.encode()) if v.bytes else 1))]
        ways += [(best[k][0] + v.score[word[k:end]], best[k][1] - 1) for k in range(end) if word[k:end] in v.score]
        best.append(max(ways))
    return -best[-1][1]


def test_counts_against_all_splits(spark, odd_texts):
    v = unigram.vocabulary(PIECES)
    rng = random.Random(1)
    words = {w for t in odd_texts if t for w in t.split(" ") if len(w) < 300} | {"".join(rng.choices("abcdehinorst", k=rng.randrange(1, 12))) for _ in range(400)} | {"日本語x", "🙂", "der", "derr", "de"}
    pre = [unigram.MARK + w for w in sorted(words, key=lambda _: rng.random())]
    assert v.counts(pre) == [brute(v, p) for p in pre]


def test_documents(odd_documents, no_documents):
    v = unigram.vocabulary(PIECES)
    want = {}
    for r in odd_documents.collect():
        words = (r.text or "").encode().split()
        want[r.doc_id] = sum(brute(v, unigram.MARK + w.decode()) for w in words if len(w) < 1000) if r.doc_id != 6 else None
    rows = unigram.token_counts(odd_documents, PIECES).collect()
    assert len(rows) == odd_documents.count()
    assert all(r.n_tokens == want[r.doc_id] for r in rows if r.doc_id != 6)
    assert not unigram.token_counts(no_documents, PIECES).collect()
