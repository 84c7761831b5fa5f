"""Collocations against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quotaline.llm import phrases
from quotaline.llm import textbatch as tb


def brute(rows, top=2000, least=10):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        f = counts.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", low):
            w = re.findall("[^\\x20\\x09]+", piece)
            totals[lang] += len(w)
            for k in (1, 2, 3):
                f.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        kept = []
        longer = [(p, a) for p, a in f.items() if len(p) == 3 and a >= least]
        most = Counter()
        for p, a in longer:
            for part in (p[:2], p[1:]):
                most[part] = max(most[part], a)
        for p, a in f.items():
            if len(p) < 2 or a < least or (len(p) == 2 and p in most and 100 * most[p] >= 50 * a):
                continue
            s, _, l, r = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))  # noqa: E741
            kept.append((-s, -a, " ".join(p).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, totals[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]  # noqa: E741
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame([(l, t, "g", 1, 2, "z") for l, t in rows], "lang string, text string, g string, n int, score int, word string").repartition(5)  # noqa: E741
    return sorted(tuple(r) for r in phrases.collocations(df, **options).collect())


def corpus(seed, n=300, kinds=120):
    """Texts with fixed phrases of two to four words, in three languages, one with few words."""
    rng = random.Random(seed)
    fixed = [[f"p{k}{c}" for c in "abcd"[: rng.randrange(2, 5)]] for k in range(25)]
    rows = []
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(60)):
            words += rng.choice(fixed) if rng.random() < 0.2 else [f"W{int(rng.paretovariate(0.9)) % kinds}"]
            if rng.random() < 0.1:
                words[-1] += rng.choice(".,;:!?\n\r\x0b")
        rows.append((rng.choice(["en", "en", "de", None]), rng.choice([" ", "  ", "\t"]).join(words)))
    return rows + [("fr", "bien sûr bien sûr " * 6), ("xx", None), (None, ""), ("en", "Ünd Ünd\xa0so " * 11)]


@pytest.mark.parametrize("top", [2000, 40, 7, 1])
def test_against_plain_counting(spark, top):
    rows = corpus(top)
    want = brute(rows, top)
    assert found(spark, rows, top=top) == want
    assert {r[0] for r in want} >= {"en", "de", "und", "fr"}


def test_waves_go_on_until_enough_stay(spark, monkeypatch):
    """Nearly all high pairs lie inside frequent triples, so the first waves leave too few."""
    monkeypatch.setattr(phrases, "AHEAD", 1)
    waves, wave = [], phrases.Miner.wave
    monkeypatch.setattr(phrases.Miner, "wave", lambda self, down_to: waves.append(dict(down_to)) or wave(self, down_to))
    rng = random.Random(1)
    rows = [("en", " ".join(rng.choice([[f"a{k}", f"b{k}", f"c{k}"] for k in range(12)])) + f". w{rng.randrange(6)} w{rng.randrange(6)}.") for _ in range(900)]
    rows += [("de", f"x{k % 30} y{k % 30}.") for k in range(600)]
    assert found(spark, rows, top=20) == brute(rows, 20)
    assert len(waves) > 1 and len(waves[0]) == 2 and len(waves[-1]) == 1  # the other language was settled
    assert all(later[g] <= waves[0][g] for later in waves for g in later)


def test_frontier_is_not_expanded_below_its_bound(spark, monkeypatch):
    counted, rows = [], corpus(5)
    counts = phrases.Miner.counted

    def seen(self, order, *maps, **among):
        out = counts(self, order, *maps, **among)
        if order == 3:
            counted.append(out.count())
        return out

    monkeypatch.setattr(phrases.Miner, "counted", seen)
    for top in (3, 2000):
        assert found(spark, rows, top=top) == brute(rows, top)
    assert counted[0] < 0.8 * counted[-1]


def test_bounds_hold(spark):
    """No extension scores more than its prefix's bound."""
    rows = corpus(9)
    df = spark.createDataFrame(rows, "lang string, text string")
    mined = phrases.Miner(df, 10)
    name = {(r.g, r.x): r.word for r in mined.words.collect()}
    lang = {r.g: r.lang for r in mined.langs.collect()}
    bound = {(lang[r.g], name[r.g, r.x], name[r.g, r.y]): r.bound for r in mined.pairs.collect()}
    triples = [(r[0], *r[2].split(" "), r[-1]) for r in brute(rows) if r[2].count(" ") == 2]
    assert triples and all(s <= bound[g, x, y] for g, x, y, _, s in triples)


def test_small_tasks_and_small_bit_maps(spark):
    """Counts handed on at once, and bit maps so small that much is taken for open by mistake."""
    rows = corpus(3, kinds=4000)
    assert found(spark, rows, top=10, least=2, bits=15, most=(50, 10)) == brute(rows, 10, 2)


def test_counts_that_share_a_key(monkeypatch):
    monkeypatch.setattr(phrases, "_key", lambda columns: np.zeros(len(columns[0]), np.uint64))
    rows, n, _ = phrases.grouped([np.array([3, 1, 3, 1, 2]), np.array([0, 5, 0, 6, 0])], np.array([1, 1, 4, 1, 1]))
    assert sorted(zip(*(r.tolist() for r in rows), n.tolist())) == [(1, 5, 1), (1, 6, 1), (2, 0, 1), (3, 0, 5)]


def test_products_beyond_64_bits(spark):
    a, b = 5_000_000_000, 2_999_999
    rows = [(a, a + 1, a + 7), (b, 3 * 10**9 + 1, 4 * 10**9), (b, b, b), (10**12, 10**13, 10**12), (7, 9, 11)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select(phrases.score("a", "l", "r").alias("s")).collect()
    assert [r.s for r in got] == [1_000_000 * x * x // (y * z) for x, y, z in rows]


def test_words_and_pieces():
    (texts,) = tb.slices(pa.array(["a b. c\td\ne", None, "f  g", "", ".h"]))
    found_, follows = phrases.words(texts)
    assert [texts.data[a:b].tobytes().decode() for a, b in zip(found_.start, found_.end)] == list("abcdefgh")
    assert follows.tolist() == [False, True, False, True, False, False, True, False]


def test_odd_documents(spark, odd_documents, odd_texts, no_documents):
    rows = [("en", t) for t in [*odd_texts, odd_texts[10], "no id here"]]
    got = sorted(tuple(r) for r in phrases.collocations(odd_documents).collect())
    assert got == brute(rows) and got
    assert phrases.collocations(no_documents).collect() == []
    assert phrases.collocations(odd_documents.where("doc_id < 3")).collect() == []
