from __future__ import annotations

import pytest

#: Texts that every operator on texts must cope with.
ODD = [None, "", " \n\t ", "x", "ü" * 3, "word " * 3000, "a" * 20_000, "<|endoftext|> <|startoftext|>", "日本語 のテキスト です", "\x1c a b c\x85d", "one two three four five six", "one two three four five six"]


@pytest.fixture(scope="session")
def odd_texts():
    return ODD


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Odd texts, a repeated row, a row without id, and columns whose names operators use themselves."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(10, ODD[10]), (None, "no id here")]
    extra = [(i, t, "en", "s", 1, -1, -2, "n", "i") for i, t in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, score int, n_tokens int, id string, ids string")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
