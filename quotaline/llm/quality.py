"""Quality of documents: shape features of the whole text, scored by a generalised additive model.

The model (see `gam`) is fitted on the driver from the features of at most about ``most`` labelled documents that are
not held out; the bound keeps what the driver holds independent of the input. All documents are scored, where their
texts are read, by adding table entries. Ids, sources, languages and labels are no features.

A null text counts as empty and is scored like one; repeated rows get equal scores; other columns are ignored; without
labels of both kinds the score is the share of label 1 (0.5 without labels). An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaline.llm import gam
from quotaline.llm import textbatch as tb
from quotaline.llm.labelled import held_out, texts_with
from quotaline.llm.shared import ship

PARTS, PART = 4, 2
SAMPLE = 20_000
FEATURES = (
    "log_words", "word_chars", "upper_words", "symbol_words", "bare_words", "different_words", "commonest_word", "echoed_words", "different_triples",
    "sentence_ends", "digit_chars", "lines", "repeated_lines", "short_words", "symbol_chars", "wide_chars", "mixed_words",
)
_ENDS = tuple(".!?…。")
_COMMON = frozenset(".,;:'\"!?()-…’“”«»¿¡")


class Shapes:
    """Facts about distinct words, and from them the features of texts."""

    def __init__(self):
        self.numbers = tb.Kept()
        self.facts = np.zeros((0, 9), np.float32)

    def _make(self, fresh: list[bytes]) -> None:
        rows = []
        for word in fresh:
            w = word.decode("utf-8")
            letters = sum(map(str.isalpha, w))
            digits = sum(map(str.isdigit, w)) if not w.isalpha() else 0
            odd = len(w) - letters - digits
            symbols = sum(c not in _COMMON and not c.isalnum() for c in w) if odd else 0
            upper = letters > 1 and w.isupper()
            rows.append((len(w), upper, symbols > 0 or "!!" in w, not letters, w.endswith(_ENDS), digits, letters <= 3, symbols, 0 < digits and 0 < letters or "://" in w or "@" in w))
        self.facts = np.concatenate([self.facts, np.array(rows, np.float32).reshape(-1, 9)])

    def _clear(self) -> None:
        self.facts = np.zeros((0, 9), np.float32)

    def features(self, texts: tb.Texts) -> np.ndarray:
        n = len(texts)
        cut = tb.words(texts)
        number = self.numbers.numbers(texts, cut, self._make, self._clear).astype(np.int64)
        doc = cut.doc
        words = np.bincount(doc, minlength=n)
        per = np.maximum(words, 1)
        chars, upper, symbol, bare, ends, digits, short, symbols, mixed = (np.bincount(doc, weights=f, minlength=n) for f in self.facts[number].T)
        size = np.maximum(chars, 1)
        pair, count = np.unique((doc << 32) | number, return_counts=True)
        top = np.zeros(n)
        np.maximum.at(top, pair >> 32, count)
        follows = np.flatnonzero((doc[1:] == doc[:-1]) & (number[1:] == number[:-1]))
        third = np.flatnonzero(doc[2:] == doc[:-2]) if len(doc) > 2 else np.zeros(0, np.int64)
        triple = number.astype(np.uint64) + np.uint64(1)
        triple = tb.mix(triple[third] + tb.mix(triple[third + 1] + tb.mix(triple[third + 2]))) >> np.uint64(24)
        triple = np.unique((doc[third].astype(np.uint64) << np.uint64(40)) | triple) >> np.uint64(40)
        line = lines(texts)
        line_hash = (line.doc.astype(np.uint64) << np.uint64(40)) | (tb.hashes(texts, line) >> np.uint64(24))
        n_lines = line.per_doc(n)
        different_lines = np.bincount((np.unique(line_hash) >> np.uint64(40)).astype(np.int64), minlength=n)
        wide = np.zeros(len(texts.data) + 1, np.int64)
        np.cumsum(texts.data >= 0xC0, out=wide[1:])
        wide = wide[texts.offsets[1:]] - wide[texts.offsets[:-1]]
        share3 = np.maximum(np.bincount(doc[third], minlength=n), 1)
        return np.stack(
            [
                np.log1p(words), chars / per, upper / per, symbol / per, bare / per, np.bincount(pair >> 32, minlength=n) / per, top / per,
                np.bincount(doc[follows], minlength=n) / per, np.bincount(triple.astype(np.int64), minlength=n) / share3,
                ends / per, digits / size, n_lines / per, 1 - different_lines / np.maximum(n_lines, 1), short / per, symbols / size, wide / size, mixed / per,
            ],
            axis=1,
        )


def lines(texts: tb.Texts) -> tb.Pieces:
    """Non-empty lines."""
    solid = np.zeros(len(texts.data) + 2, bool)
    solid[1:-1] = texts.data != 10
    edge = np.zeros(len(texts.data) + 1, bool)
    edge[texts.offsets] = True
    start = np.flatnonzero(solid[1:] & (~solid[:-1] | edge))
    end = np.flatnonzero(solid[:-1] & (~solid[1:] | edge))
    return tb.Pieces(start, end, np.searchsorted(texts.offsets, start, side="right") - 1)


_shapes: list[Shapes] = []


def shapes() -> Shapes:
    """This worker's facts about words."""
    if not _shapes:
        _shapes.append(Shapes())
    return _shapes[0]


def learn(documents: DataFrame, labels: DataFrame, most: int = SAMPLE, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> gam.Gam:
    """The model of labelled documents that are not held out."""
    ship(documents.sparkSession)

    def run(batches):
        for batch in batches:
            y = batch.column(2)
            for texts in tb.slices(batch.column(1), tb.SMALL_SLICE_BYTES):
                x = shapes().features(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first, len(texts)), y.slice(texts.first, len(texts)), pa.array(list(x), pa.list_(pa.float64()))], ["id", "y", "x"])

    rows = texts_with(documents, labels, label_col, PARTS, PART, most, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    # about ``most`` rows of a few numbers; in one order, so that every run gives the same model
    got = rows.mapInArrow(run, f"id {kind}, y int, x array<double>").toPandas().sort_values("id", kind="stable")
    x = np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES))
    return gam.fit(x, got["y"].to_numpy(float))


def scored(documents: DataFrame, model: gam.Gam, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1) of every row, empty texts too."""
    ship(documents.sparkSession)
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for texts in tb.slices(batch.column(1), tb.SMALL_SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first, len(texts)), pa.array(model.score(shapes().features(texts)))], ["id", "score"])

    return documents.select(documents[id_col].alias("id"), documents[text_col].alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def accepted(documents: DataFrame, model: gam.Gam, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is at least ``threshold``."""
    ship(documents.sparkSession)
    place = documents.columns.index(text_col)

    def run(batches):
        for batch in batches:
            score = [model.score(shapes().features(texts)) for texts in tb.slices(batch.column(place), tb.SMALL_SLICE_BYTES)]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0), *score]) >= threshold))

    return documents.mapInArrow(run, documents.schema)


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``held_out``, ``score``, ``predicted`` (1 from ``threshold``) of every document."""
    out = scored(documents, learn(documents, labels, most, "quality", id_col, text_col), id_col, text_col)
    return out.select(id_col, held_out(F.col(id_col), PARTS, PART).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
