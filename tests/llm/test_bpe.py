from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quotaline.llm import bpe
from quotaline.llm import textbatch as tb
from quotaline.llm.queries import BYTE_BPE

LIBRARY = Tokenizer.from_file(BYTE_BPE)


def ids_of(texts, most=1 << 20):
    out = []
    for part in tb.slices(pa.array(texts, pa.string()), most):
        ids, at = bpe.codec(BYTE_BPE).encode(part)
        out += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    return out


def test_same_ids_as_the_library(odd_texts):
    texts = [t or "" for t in odd_texts] + ["  two  spaces ", "don't we'll I'M", "tail \n ", "<|endoftext|>", "a<|endoftext|>b  <|endoftext|> c", "🙂🙂 ok", "é é", "1234 56"]
    assert ids_of(texts) == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\tab'sé 　.,1日🙂<|>"), st.characters(codec="utf-8")), max_size=40), max_size=5))
def test_any_text(texts):
    assert ids_of(texts, 16) == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("length", [bpe.WIDE - 1, bpe.WIDE, bpe.WIDE + 1, 700])
def test_long_pretokens(length):
    words = ["ab" * length, "the" * length, "=" * length]
    flat, begin, count = bpe.codec(BYTE_BPE).encode_pieces([w.encode() for w in words])
    assert [flat[b : b + n].tolist() for b, n in zip(begin, count)] == [LIBRARY.encode(w, add_special_tokens=False).ids for w in words]


def test_decode_of_broken_characters():
    ids = LIBRARY.encode("日本", add_special_tokens=False).ids[:-1] + [50256]
    assert bpe.codec(BYTE_BPE).decode(np.array(ids)) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_round_trip(odd_documents, no_documents):
    for r in bpe.round_trip(odd_documents, BYTE_BPE).join(odd_documents.select("doc_id", "text"), "doc_id").collect():
        ids = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4")).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.round_trip(odd_documents, BYTE_BPE).count() == odd_documents.count()
    assert not bpe.round_trip(no_documents, BYTE_BPE).collect()


def test_encode_then_decode(odd_documents):
    encoded = bpe.encode(odd_documents, BYTE_BPE)
    back = {r.doc_id: r.text for r in bpe.decode(encoded, BYTE_BPE).collect()}
    assert back == {r.doc_id: r.text or "" for r in odd_documents.collect()}


def test_words_kept_are_dropped_when_there_are_too_many():
    codec = bpe.Codec(BYTE_BPE)
    codec.numbers.most = 3
    for texts in (["a b c d e"], ["f g h i"], ["a z"]):
        for part in tb.slices(pa.array(texts)):
            assert codec.encode(part)[0].tolist() == LIBRARY.encode(texts[0], add_special_tokens=False).ids
