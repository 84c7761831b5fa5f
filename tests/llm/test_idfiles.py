"""Compressed id files: the coder against its input, files against the tokenizers library."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quotaline.llm import idcoder, idfiles, queries


def library():
    t = Tokenizer.from_file(queries.WORD_BPE)
    t.no_truncation()
    t.no_padding()
    return t


def expected(rows, end_id=1):
    """(id, start, ids) of every row in ascending order of id."""
    t, at, out = library(), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((i, at, ids))
        at += len(ids)
    return out


@pytest.mark.parametrize("n", [1, 2, 127, 129, 5000, 70_000])
@pytest.mark.parametrize("kind", ["even", "skewed", "repeated", "constant"])
def test_coder_gives_back_what_it_got(n, kind):
    rng = np.random.default_rng(n)
    ids = {
        "even": lambda: rng.integers(0, 1000, n),
        "skewed": lambda: np.minimum(rng.zipf(1.3, n), 999),
        "repeated": lambda: np.resize(rng.integers(0, 1000, 37), n),
        "constant": lambda: np.full(n, 999),
    }[kind]()
    lengths = np.array([n // 3, 0, n - n // 3])
    data = idcoder.block(ids, lengths, 1000)
    got, sizes = idcoder.texts(data)
    assert got.tolist() == ids.tolist() and sizes.tolist() == lengths.tolist()
    if n == 70_000:
        plain = n * np.log2(1000) / 8
        assert len(data) < {"even": 1.06, "skewed": 0.7, "repeated": 0.15, "constant": 0.05}[kind] * plain


@pytest.mark.parametrize("vocab", [1, 2, 3, 70_000, 300_000])
def test_coder_for_any_vocabulary(vocab):
    ids = np.random.default_rng(0).integers(0, vocab, 3000)
    assert idcoder.texts(idcoder.block(ids, np.array([3000]), vocab))[0].tolist() == ids.tolist()
    with pytest.raises(ValueError):
        idcoder.block(np.array([vocab]), np.array([1]), vocab)


def test_carries_run_through_digits(monkeypatch):
    """Narrow weights and long runs of the likeliest id push the low end across many digits."""
    for seed in range(20):
        rng = np.random.default_rng(seed)
        ids = np.where(rng.random(20_000) < 0.999, 49_407, rng.integers(0, 49_408, 20_000))
        assert idcoder.texts(idcoder.block(ids, np.array([20_000]), 49_408))[0].tolist() == ids.tolist()


def test_order_two_is_learned():
    """Ids that only the pair before tells: after 2, order 1 sees 3 and 5 in turn."""
    ids = np.resize([1, 2, 3, 4, 2, 5], 500_000)
    assert len(idcoder.block(ids, np.array([len(ids)]), 1000)) * 8 / len(ids) < 0.4  # order 1 alone: a bit in three ids, and the lanes


def test_damage_is_found():
    ids = np.random.default_rng(1).integers(0, 500, 4000)
    data = bytearray(idcoder.block(ids, np.array([4000]), 500))
    for at in (0, 5, 20, 30, idcoder.HEADER.size + 2, len(data) - 3):
        bad = bytearray(data)
        bad[at] ^= 0x40
        with pytest.raises((idcoder.Damaged, struct.error, ValueError, IndexError, MemoryError)):
            idcoder.texts(bytes(bad))


def test_files_hold_the_librarys_ids(spark, odd_documents, odd_texts, tmp_path):
    idfiles.write(odd_documents, queries.WORD_BPE, f"{tmp_path}/ids", block=500)
    got = idfiles.read(spark, f"{tmp_path}/ids").orderBy("start").collect()
    rows = [(i, t) for i, t in enumerate(odd_texts)] + [(10, odd_texts[10]), (None, "no id here")]
    assert [(r.doc_id, r.start, r.ids) for r in got] == expected(rows)
    assert all(r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)


def test_a_range_of_documents(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["red", "green", "blue", "purple7"], k=rng.randrange(40)))) for i in range(-50, 900)]
    rng.shuffle(rows)
    idfiles.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), queries.WORD_BPE, f"{tmp_path}/ids", block=300)
    want = [(i, a, len(x)) for i, a, x in expected(rows)]
    got = idfiles.read(spark, f"{tmp_path}/ids", with_ids=False).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in got) == want
    some = idfiles.read(spark, f"{tmp_path}/ids", 100, 120, with_ids=False)
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in some.collect()) == [w for w in want if 100 <= w[0] <= 120]
    assert spark.read.parquet(f"{tmp_path}/ids").where("last_id >= 100 AND first_id <= 120").count() < spark.read.parquet(f"{tmp_path}/ids").count() / 10


def test_a_hot_id_fills_several_files(spark, tmp_path):
    rows = [(7 if i % 3 else i, f"text {i}") for i in range(3000)] + [(None, f"none {i}") for i in range(1500)]
    idfiles.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), queries.WORD_BPE, f"{tmp_path}/ids", block=2000)
    parts = spark.read.parquet(f"{tmp_path}/ids").groupBy("part").sum("n_ids").collect()
    assert len(parts) > 8 and max(r[1] for r in parts) < 3 * sum(r[1] for r in parts) / len(parts)
    got = idfiles.read(spark, f"{tmp_path}/ids").orderBy("start").collect()
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order) and len(got) == len(rows)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    assert sorted(map(repr, ((r.doc_id, r.ids) for r in got))) == sorted(map(repr, ((i, x) for i, _, x in expected(rows))))


def test_no_documents(spark, no_documents, tmp_path):
    idfiles.write(no_documents, queries.WORD_BPE, f"{tmp_path}/ids")
    assert idfiles.read(spark, f"{tmp_path}/ids").collect() == []


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    got = queries.op12_binary_output(spark, folder).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = [(i, a, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, a, x in expected(rows)]
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want
