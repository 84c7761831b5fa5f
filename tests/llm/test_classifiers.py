from __future__ import annotations

import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quotaline.llm import gam, labelled, language, quality, toxicity
from quotaline.llm import textbatch as tb

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("documents", "labels")]


@pytest.fixture(scope="module")
def some_labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)] + [(3, 1, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")


def accuracy(predicted, labels, column, where="held_out"):
    rows = predicted.where(where).join(labels, "doc_id").select("predicted", column).collect()
    assert len(rows) > 500
    hits = {y: [r[0] for r in rows if r[1] == y] for y in (0, 1)}
    return sum(hits[1]) / len(hits[1]), 1 - sum(hits[0]) / len(hits[0])


def test_quality_on_held_out_documents(tables):
    caught, left = accuracy(quality.classify(*tables), tables[1], "quality")
    assert caught > 0.99 and left > 0.97


def test_toxicity_on_held_out_documents(tables):
    caught, left = accuracy(toxicity.classify(*tables), tables[1], "toxic")
    assert caught > 0.84 and left > 0.99


def test_language_on_held_out_documents(tables):
    got = language.predict(tables[0]).where("held_out").join(tables[0].select("doc_id", "lang"), "doc_id").select("lang", "lang_pred").collect()
    assert sum(r[0] == r[1] for r in got) / len(got) > 0.99


@pytest.mark.parametrize(("classify", "parts", "part"), [(quality.classify, 4, 2), (toxicity.classify, 3, 1)])
def test_odd_documents(odd_documents, no_documents, some_labels, classify, parts, part):
    rows = classify(odd_documents, some_labels).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % parts == part) for r in rows)
    scores = [r.score for r in rows if r.doc_id in (10, 11)]
    assert len(scores) == 3 and len(set(scores)) == 1  # equal texts
    assert not classify(no_documents, some_labels).collect()
    assert len(classify(odd_documents, some_labels.limit(0)).collect()) == len(rows)
    assert len(classify(odd_documents, some_labels.where("quality = 1")).collect()) == len(rows)


def test_held_out_labels_change_nothing(spark, tables):
    documents = tables[0].limit(300)
    labels = tables[1]
    from pyspark.sql import functions as F

    for classify, column, parts, part in ((quality.classify, "quality", 4, 2), (toxicity.classify, "toxic", 3, 1)):
        other = labels.withColumn(column, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == part, 1 - F.col(column)).otherwise(F.col(column)))
        assert {r.doc_id: r.score for r in classify(documents, labels).collect()} == {r.doc_id: r.score for r in classify(documents, other).collect()}


def test_accepted_rows_keep_their_columns(odd_documents):
    model = gam.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0))
    assert quality.accepted(odd_documents, model, 0.4).columns == odd_documents.columns
    assert quality.accepted(odd_documents, model, 0.4).count() == odd_documents.count()
    assert quality.accepted(odd_documents, model, 0.6).count() == 0


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = gam.fit(x, y, n_pairs=2)
    assert (0, 1) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.9


def test_trees():
    g, h = np.array([-5.0, -5.0, 5.0, 5.0]), np.ones(4)
    assert gam.tree(g, h, 0.0, 2).tolist() == [-5, -5, 5, 5]
    assert gam.tree(np.zeros(3), np.ones(3), 1.0).tolist() == [0, 0, 0]
    gain, values = gam.tree2(np.array([[3.0, -3.0], [-3.0, 3.0]]), np.ones((2, 2)), 0.0)
    assert gain == pytest.approx(36) and values.tolist() == [[3, -3], [-3, 3]]


def clause(text, weights=None):
    scorer = toxicity.Scorer(toxicity.Model(weights or {}))
    for part in tb.slices(pa.array([text])):
        return scorer.raw(part)[0, 0]


def test_the_grammar_scores_clauses():
    plain = clause("there is an idiot")
    assert clause("you idiot") > plain > clause("that is not an idiot") > 0
    assert plain > clause("someone said there is an idiot")
    assert clause("they will kill it") == 0 and clause("i will kill you") > clause("i will never kill you") > 0
    assert clause("nothing to see") == 0
    assert clause("I met one. Idiot") == clause("I met one idiot")
    assert clause("idiot idiot idiot") == clause("idiot")
    assert clause("zzebra", {"zzeb-": 2.0}) == 2.0


def test_composition_is_the_product():
    to, factor, added = toxicity.grammar()
    assert to.shape == factor.shape == added.shape and to.max() < len(to) and (factor > 0).all()


def test_spans_of_mixed_text(spark, tables):
    docs = tables[0]
    model = language.learn(docs)
    first = {r.lang: r.text for r in docs.where("length(text) > 2000 AND lang IN ('en', 'de')").limit(200).collect()}
    en, de = (" ".join(first[k].split()[:80]) for k in ("en", "de"))
    row = language.identify(spark.createDataFrame([(1, f"{en} {de} {en}")], "doc_id long, text string"), model).first()
    spans = [(s.lang, s.last_word - s.first_word + 1) for s in row.spans]
    assert [s[0] for s in spans] == ["en", "de", "en"] and all(abs(n - 80) < 8 for _, n in spans)
    assert row.lang_pred == "en" and 0.4 < row.score < 0.9


def test_language_of_odd_documents(odd_documents, no_documents, tables):
    rows = language.predict(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert all(r.lang_pred == "en" or (r.lang_pred == "und" and r.score == 0) for r in rows)
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {0, 1, 2}
    assert not language.predict(no_documents).collect()
    from pyspark.sql import functions as F

    nobody = odd_documents.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.predict(nobody).collect()} == {"und"}
    assert language.accepted(odd_documents, language.learn(odd_documents)).columns == odd_documents.columns


def test_scripts_narrow_the_candidates(spark):
    rows = [(i, "мир и слово дом", "ru") for i in range(40)] + [(100 + i, "the word and house", "en") for i in range(40)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = language.identify(spark.createDataFrame([(1, "щжэю фыва"), (2, "qwrt zxcv"), (3, "щжэю the house and the word")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["ru", "en", "en"] and [s.lang for s in got[2].spans] == ["ru", "en"]


def test_viterbi_against_all_labellings():
    from itertools import product

    rng = np.random.default_rng(4)
    sizes = np.array([5, 0, 1, 6, 3])
    scores = rng.normal(size=(sizes.sum(), 3)).astype(np.float32)
    got, at = language.viterbi(scores, sizes, 0.7), 0
    for n in sizes.tolist():
        part = scores[at : at + n]
        value = lambda p: sum(part[i, k] for i, k in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max(map(value, product(range(3), repeat=n)))
        assert value(got[at : at + n].tolist()) == pytest.approx(best, abs=1e-5)
        at += n


def test_a_rare_language_is_learned_from_a_sample(spark):
    rows = [(i, "the house and the garden", "en") for i in range(6000)] + [(6000 + i, "das haus und der garten", "de") for i in range(3000)]
    rows += [(9000 + i, "talo ja puutarha", "fi") for i in range(4)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.learn(documents, 200).languages == ["de", "en", "fi"]
    drawn = labelled.sampled_of_each(documents, "doc_id", "lang", 200)
    n = {r["lang"]: r["count"] for r in drawn.groupBy("lang").count().collect()}
    assert n["fi"] == 4 and all(60 <= n[x] <= 140 for x in ("de", "en")) and drawn.columns == documents.columns


def test_languages_that_were_not_learned_are_rejected(spark):
    words = {"en": "the house and the garden were full of people who sang", "de": "das haus und der garten waren voller leute die sangen"}
    rows = [(k, words[lang], lang) for k in range(60) for lang in words]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = {1: words["en"], 2: "в доме и в саду было много людей которые пели песни", 3: "家の中と庭には歌う人がたくさんいました", 4: words["de"] + " " + words["en"], 5: words["en"] + " в доме и в саду было много людей которые пели песни и ели вкусный хлеб", 6: None, 7: "12 34"}
    docs = spark.createDataFrame(list(odd.items()), "doc_id long, text string")
    assert {r.doc_id for r in language.accepted(docs, model).collect()} == {1, 4}


def test_new_words_are_scored_a_few_at_a_time(monkeypatch):
    rng = np.random.default_rng(3)
    words = [bytes(w) for w in rng.integers(97, 123, (60_000, 10), dtype=np.uint8)]
    model = language.Model(["a", "b", "c"], rng.normal(size=(language.BUCKETS, 3)).astype(np.float32), np.ones((len(language.SCRIPTS) + 1, 3), bool))
    few, all_ = language.Scorer(model), language.Scorer(model)
    tracemalloc.start()
    few._make(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    monkeypatch.setattr(language, "SCORED", 1 << 20, raising=False)
    all_._make(words)
    assert (few.scores == all_.scores).all() and (few.letters == all_.letters).all() and (few.known == all_.known).all()
