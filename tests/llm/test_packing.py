from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quotaline.llm import packing
from quotaline.llm import textbatch as tb
from quotaline.llm.queries import WORD_BPE

LIBRARY = Tokenizer.from_file(WORD_BPE)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \nab'sÉß×.,1٣日İΣ́<|>"), st.characters(codec="utf-8")), max_size=30), max_size=5))
def test_same_ids_as_the_library(texts):
    for part in tb.slices(pa.array(texts, pa.string())):
        ids, at = packing.encoder(WORD_BPE).encode(part)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [ids_of(t) for t in texts[part.first : part.first + len(part)]]


def test_parts_of_words_are_cut_once(monkeypatch):
    """Words that differ in case and punctuation share their parts, over slices and after words are dropped."""
    seen = []

    class Counted:
        def tokenize(self, letters):
            seen.append(letters)
            return LIBRARY.model.tokenize(letters)

    def check(*texts):
        for text in texts:
            for part in tb.slices(pa.array([text])):
                assert e.encode(part)[0].tolist() == ids_of(text)

    e = packing.WordTokens(WORD_BPE)
    e.model = Counted()
    check("Étude one", "étude, 日本 ONE! don't", "one.")
    assert sorted(seen) == sorted({*seen}) and len(seen) == 7
    e.numbers.clear(), e.ids.clear()
    check("one étude")
    assert len(seen) == 7
    monkeypatch.setattr(packing, "KEPT_PARTS", 3)
    check("two! one", "three four five", "one five two")
    assert len(e.parts) <= 5


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("'stmdrevla09.é!|", min_size=1, max_size=12), min_size=1, max_size=5))
def test_parts_are_those_of_the_files_pattern(runs):
    pattern = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\n]+|\n")
    lines = "".join(run + "\n" for run in runs)
    data = lines.encode()
    start = packing.parts_of(np.frombuffer(data, np.uint8)).tolist()
    assert [data[a:b].decode() for a, b in zip(start, [*start[1:], None])] == pattern.findall(lines)


def test_nothing_is_kept_once_another_operator_starts():
    part = next(tb.slices(pa.array(["one two, three"])))
    e, other = packing.WordTokens(WORD_BPE), tb.Kept()
    e.encode(part)
    assert len(e.parts) == 4
    other.numbers(part, tb.words(part), lambda fresh: None, lambda: None)
    assert not len(e.parts) and not e.ids.used and not e.part_ids.used
    assert e.encode(part)[0].tolist() == ids_of("one two, three")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60))
def test_pack_loses_and_pads_nothing(lengths):
    lengths = np.array(lengths, np.int64)
    pieces = packing.pack(lengths, capacity=64)
    used, covered = defaultdict(list), defaultdict(list)
    for doc, start, n, sequence, offset in pieces.tolist():
        used[sequence].append((offset, n))
        covered[doc].append((start, n))
    for spans, whole in [*((covered[d], int(n)) for d, n in enumerate(lengths)), *((s, None) for s in used.values())]:
        at = 0
        for start, n in sorted(spans):
            assert start == at and n > 0
            at += n
        assert at == whole if whole is not None else at == 64 or at & (at - 1) == 0
    assert sum(sum(n for _, n in s) for s in used.values()) == lengths.sum()


def test_descending_documents_go_to_the_cheapest_sequence():
    pieces = packing.pack(np.array([40, 40, 20, 20, 4, 4]), capacity=64)
    by_sequence = defaultdict(list)
    for doc, _, n, sequence, _ in pieces.tolist():
        by_sequence[sequence].append(n)
    assert sorted(map(sorted, by_sequence.values())) == [[4, 20, 40], [4, 20, 40]]


@pytest.mark.parametrize("group_tokens", [64, 1 << 22])
def test_pieces_hold_every_id_once(odd_documents, no_documents, group_tokens):
    rows = packing.packed(odd_documents.where("doc_id <> 10"), WORD_BPE, group_tokens=group_tokens).collect()
    texts = {r.doc_id: r.text for r in odd_documents.collect()}
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4"))
        parts[r.doc_id].append((r.start, r.ids, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(parts) == {i for i in texts if i is not None and i != 10}
    for doc, pieces in parts.items():
        whole = [i for _, ids, _ in sorted(pieces) for i in ids]
        assert whole == ids_of(texts[doc]) + [2] and {n for _, _, n in pieces} == {len(whole)}
    for spans in sequences.values():
        end = 0
        for offset, n in sorted(spans):
            assert offset == end
            end += n
        assert end == packing.CAPACITY or end & (end - 1) == 0
    assert not packing.packed(no_documents, WORD_BPE).collect()


def test_repeated_rows_and_rows_without_id_are_packed(odd_documents):
    rows = packing.packed(odd_documents, WORD_BPE, with_ids=False)
    assert rows.where("doc_id IS NULL").agg({"length": "sum"}).first()[0] == len(ids_of("no id here")) + 1
    assert rows.where("doc_id = 10").agg({"length": "sum"}).first()[0] == 2 * (len(ids_of("one two three four five six")) + 1)
    assert "ids" not in rows.columns
