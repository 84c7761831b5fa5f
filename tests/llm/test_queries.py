"""Registered queries against their SQL, and the pipeline against plain Python."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from checks.compare import difference
from quotaline.llm import language, packing, quality, queries
from tests.llm.test_neardup import brute

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    c = duckdb.connect()
    for name in ("documents", "embeddings", "labels", "conversations"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, connection, name):
    df = queries.queries()[name](spark, SMALL)
    assert difference(df.collect(), df.columns, connection, queries.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", ["op1_quality_classifier", "op2_packing", "op3_toxicity", "op5_bpe", "op8_token_counts", "op10_language_id"])
def test_every_document_has_a_result(spark, name):
    ids = {r.doc_id for r in queries.queries()[name](spark, SMALL).collect()}
    assert ids == {r.doc_id for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    scored = quality.scored(docs, quality.learn(docs, spark.read.parquet(f"{SMALL}/labels.parquet")))
    good = docs.join(scored.where("score >= 0.7"), "doc_id", "left_semi")
    known = language.identify(good, language.learn(good), False).where("lang_pred <> 'und' AND score >= 0.5")
    rows = [(r.doc_id, r.text) for r in good.join(known, "doc_id", "left_semi").collect()]
    stay = {i: n for i, n, c in brute(rows) if i == c}
    assert 0 < len(stay) < len(rows) < docs.count()
    pieces = corpus_pipeline.run(spark, SMALL).collect()
    text, tokens, encoder = dict(rows), {}, packing.encoder(queries.WORD_BPE).tokenizer
    for p in pieces:
        tokens[p.doc_id] = tokens.get(p.doc_id, 0) + p.length
    assert tokens == {i: len(encoder.encode(text[i], add_special_tokens=False).ids) + 1 for i in stay}


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), SMALL)
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SMALL).count() == 0


def test_dedup_stage_loses_no_text(spark):
    """Ids that repeat with other texts, equal rows, and rows without id: one row of each text stays."""
    a, b, c, n = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcn")
    rows = [(1, a, "en"), (5, a, "de"), (5, b, "en"), (7, c, "en"), (7, c, "en"), (None, n, "en"), (None, n, "en"), (None, a, "en"), (8, None, "en"), (9, "", None)]
    docs = spark.createDataFrame([(*r, "s", 1, -1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row long")
    out = corpus_pipeline.near_dedup(spark, docs, SMALL)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(1, a), (5, b), (7, c), (None, n), (8, None), (9, "")], key=repr)


def test_stages_on_odd_documents(spark, odd_documents):
    """Nulls, repeated rows, long texts and clashing names pass through every stage; texts without copies stay."""
    text = "word " * 3000
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd_documents, SMALL)
        assert out.columns == odd_documents.columns, name
        kept = [(r.doc_id, r.text) for r in out.collect()]
        assert len(kept) <= odd_documents.count(), name
        if name == "near_dedup":
            assert sorted(t for _, t in kept if t) == sorted({r.text for r in odd_documents.collect() if r.text} ) and (5, text) in kept
    assert corpus_pipeline.STAGES[-1][1](spark, odd_documents, SMALL).agg({"length": "sum"}).first()[0] > 3000
