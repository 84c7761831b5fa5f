from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from quotaline.llm import multi_index, topk
from quotaline.llm.queries import op9_nearest_neighbours

INF, NAN = float("inf"), float("nan")


def frame(spark, rows):
    rows = [(i, v and [x if x is None else float(x) for x in v]) for i, v in rows]
    return spark.createDataFrame([(i, v, 0, 0, 0.0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, rank int, score double, id string")


def brute(rows, k, every, scale=None):
    """Every row against every query, in plain Python."""
    good = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        v = [float(np.float32(x)) for x in v]
        if scale:
            v = [int(np.floor(scale * x)) for x in v]
        elif not any(v):
            continue
        good[i] = min(v, good.get(i, v))
    out = []
    for q, a in good.items():
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good.items() if i != q and len(a) == len(b))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def odd_rows():
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 6) / 4]) for i in range(300)]  # many ties
    rows += [(i, [0.5] * 6) for i in range(300, 420)]  # a hot vector
    rows += [(400, [0.25] * 6), (400, [0.5] * 6), (5, rows[5][1]), (None, [1.0] * 6), (600, None), (601, []), (602, [1.0, None, 0, 0, 0, 0]), (603, [INF] * 6), (604, [NAN] * 6)]
    rows += [(620, [1.0, 2.0]), (640, [-1.0, 0.5]), (660, [1.0]), (680, [0.0] * 6)]  # other dimensions, a zero vector
    return rows


def collected(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("block", [64, 2048])
def test_top_k_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rows = odd_rows()
    assert collected(topk.top_k(frame(spark, rows), lambda i: i % 20 == 0, k=7)) == sorted(brute(rows, 7, 20, 64))


def test_top_k_with_few_rows_and_large_numbers(spark):
    rows = [(0, [1e7, -1e7]), (1, [1e7, 1.0]), (2, [-1e7, 3.0]), (20, [0.0, 0.0])]
    assert collected(topk.top_k(frame(spark, rows), lambda i: i % 20 == 0)) == sorted(brute(rows, 20, 20, 64))
    for few in ([], [(0, [1.0])], [(1, [1.0]), (2, [1.0])]):
        assert not topk.top_k(frame(spark, few), lambda i: i % 20 == 0).collect()


def test_search_finds_all_if_it_may_look_everywhere(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 64)
    monkeypatch.setattr(multi_index, "QUERIES", 4)
    rows = odd_rows()
    got, want = collected(multi_index.search(frame(spark, rows), lambda i: i % 20 == 0, k=7)), sorted(brute(rows, 7, 20))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12, atol=1e-12)
    for few in ([], [(0, [1.0, 2.0])], [(1, [1.0, 0.0]), (2, [1.0, 0.0])]):
        assert not multi_index.search(frame(spark, few), lambda i: i % 20 == 0).collect()


def test_walk_goes_by_summed_distance():
    first, second = np.array([3.0, 1.0, 2.0]), np.array([0.5, 0.1])
    entries = np.array([1, 2, 3, 0, 5, 6])
    cells = multi_index.walk(first, second, entries, 1000)
    total = (first[:, None] + second).ravel()
    assert cells == [c for c in np.argsort(total, kind="stable").tolist() if entries[c]]
    assert multi_index.walk(first, second, entries, 3) == cells[:2] or multi_index.walk(first, second, entries, 3) == cells[:1]


def test_recall_of_the_registered_query(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    found = {}
    for r in op9_nearest_neighbours(spark, folder).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        best = ids[np.argsort(-s, kind="stable")[:20]]
        hit, total = hit + len(found[ids[q]] & set(best.tolist())), total + 20
    assert hit / total >= 0.9


def test_half_of_the_entries_reach_nine_tenths_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))])
    found = {}
    for r in multi_index.search(df, lambda i: i % 100 == 0, k=20).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, 6000, 100):
        s = x @ x[q]
        s[q] = -9
        hit += len(found[q] & set(np.argsort(-s)[:20].tolist()))
    assert hit / (60 * 20) >= 0.9


@pytest.mark.parametrize("factor", [2.0, 3.0, 10.0, None])
def test_recall_with_vectors_of_different_lengths(spark, factor):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x *= np.exp(rng.normal(size=(6000, 1)) / 2) if factor is None else np.where(rng.random((6000, 1)) < 1 / 3, factor, 1.0)
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))])
    found = {}
    for r in multi_index.search(df, lambda i: i % 100 == 0, k=20).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, 6000, 100):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(found[q] & set(np.argsort(-s)[:20].tolist()))
    print("recall", factor, hit / (60 * 20))
    assert hit / (60 * 20) >= 0.9


@pytest.mark.parametrize("most", [120, 40])
def test_a_task_holds_a_bounded_number_of_pairs(monkeypatch, most):
    """10 queries beside 8 blocks of 12 entries; 3 best each are 30 pairs a block."""
    rng = np.random.default_rng(5)
    q, e = rng.normal(size=(10, 4)), rng.normal(size=(96, 4))
    held, merge = [], multi_index._merged
    monkeypatch.setattr(multi_index, "MERGED", most)
    monkeypatch.setattr(multi_index, "_merged", lambda rows, k: held.append(sum(len(r[0]) for r in rows)) or merge(rows, k))

    def batches():
        for b in range(8):
            yield pa.RecordBatch.from_pydict({
                "dim": [4], "ids": [list(range(1000, 1010))], "vecs": [q.ravel()], "cells": [[b]], "sizes": [[10]], "members": [list(range(10))],
                "e_cells": [[b] * 12], "e_ids": [list(range(12 * b, 12 * b + 12))], "e_vecs": [e[12 * b : 12 * b + 12].ravel()],
            })

    rows = [r for out in multi_index._rerank(3)(batches()) for r in out.to_pylist()]
    assert len(held) > 1 and max(held) <= most + 30
    for i in range(10):
        own = sorted((-r["score"], r["id"]) for r in rows if r["query_id"] == 1000 + i)[:3]
        assert [x for _, x in own] == np.argsort(-(e @ q[i]))[:3].tolist()
