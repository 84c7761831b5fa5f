"""Language identification of mixed text: script ranges, scores of words, and Viterbi over spans.

Learning counts, per language, letter n-grams of words (with the word's ends) in ``BUCKETS`` hashed places, and how
many letters of each script the language is written with. A word's letters tell its script, and only languages written
in that script are candidates for it (all, if none is). A word's score for a language is the weighted sum of its
n-grams' log probabilities there; words without letters say nothing. Over a text's words, Viterbi finds the labelling
with the highest sum of scores, less a penalty for each change of language. Runs of equal labels are the spans; the
language with most letters in them is the text's, and its share of the letters the score.

Learned from the text and language of at most about ``most`` documents that are not held out, all of those in rarer
languages and equally many in each of the others, so every language is learned; the driver gets at most
``BUCKETS`` counts a language. Texts are labelled where they are read, all texts of a few slices in step: words of the
same place in their texts are handled together, longest texts first.

A null text, or one without a letter, is ``und`` with score 0, as is every text if nothing could be learned. Ties go to
the language that sorts first. Repeated rows get equal results; columns other than id, text and language are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaline.llm import textbatch as tb
from quotaline.llm.labelled import held_out, sampled_of_each
from quotaline.llm.shared import ship

PARTS, PART = 4, 2
SAMPLE = 20_000
BUCKETS = 1 << 15
SIZES = (1, 2, 3, 4)
#: Words whose labels are found together, and new words that are scored together.
TOGETHER, SCORED = 500_000, 10_000
#: First and last code points of scripts, from the block table of Unicode; other letters are of script 0.
SCRIPTS = (
    ("Latin", ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A))),
    ("Greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("Cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("Armenian", ((0x530, 0x58F),)),
    ("Hebrew", ((0x590, 0x5FF),)),
    ("Arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF))),
    ("Devanagari", ((0x900, 0x97F), (0xA8E0, 0xA8FF))),
    ("Bengali", ((0x980, 0x9FF),)),
    ("Tamil", ((0xB80, 0xBFF),)),
    ("Thai", ((0xE00, 0xE7F),)),
    ("Georgian", ((0x10A0, 0x10FF), (0x2D00, 0x2D2F))),
    ("Hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7FF))),
    ("Kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF))),
    ("Han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F))),
)
_RANGES = sorted((a, b, k + 1) for k, (_, ranges) in enumerate(SCRIPTS) for a, b in ranges)
_FROM, _TO, _SCRIPT = (np.array(x) for x in zip(*_RANGES))


def scripts_of(points: np.ndarray) -> np.ndarray:
    """The script of each code point, 0 for none of the ranges."""
    k = np.maximum(np.searchsorted(_FROM, points, side="right") - 1, 0)
    return np.where((points >= _FROM[k]) & (points <= _TO[k]), _SCRIPT[k], 0)


def letters(words: list[bytes]) -> list[str]:
    """Each word's letters and the marks on them, in lower case."""
    out = []
    for word in words:
        w = word.decode("utf-8").lower()
        out.append(w if w.isalpha() else "".join(c for c in w if c.isalpha() or (not c.isascii() and unicodedata.category(c)[0] == "M")))
    return out


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of non-empty words: hashed n-grams, the word of each, and its weight; and each word's commonest script."""
    joined = "".join(f" {w} " for w in words)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
    length = np.array([len(w) + 2 for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), length)
    hashed, whose = [], []
    for n in SIZES:
        at = np.flatnonzero(word[n - 1 :] == word[: len(word) - n + 1]) if len(word) >= n else np.zeros(0, np.int64)
        if n == 1:
            at = at[points[at] != 32]
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = tb.mix(h * np.uint64(31) + points[at + k].astype(np.uint64))
        hashed.append((h >> np.uint64(40)).astype(np.int64) % BUCKETS)
        whose.append(word[at])
    inside = points != 32
    n_scripts = len(SCRIPTS) + 1
    script = np.bincount(word[inside] * n_scripts + scripts_of(points[inside]), minlength=len(words) * n_scripts).reshape(-1, n_scripts).argmax(axis=1)
    return np.concatenate(hashed), np.concatenate(whose), script


@dataclass
class Model:
    """Languages, log probabilities (bucket, language) and which scripts (script, language) each is written in."""

    languages: list[str]
    logs: np.ndarray
    written: np.ndarray
    penalty: float = 12.0

    def key(self) -> bytes:
        return hashlib.sha256(repr((self.languages, self.penalty)).encode() + self.logs.tobytes() + self.written.tobytes()).digest()


class Scorer:
    """A model, and the scores of this worker's distinct words."""

    def __init__(self, model: Model):
        self.model, self.numbers = model, tb.Kept(600_000)
        self._clear()

    def _clear(self) -> None:
        self.scores, self.letters = np.zeros((0, len(self.model.languages)), np.float32), np.zeros(0, np.int32)
        self.known = np.zeros(0, np.int32)  # letters of words in a script that some language is written in

    def _make(self, fresh: list[bytes]) -> None:
        found = [self._scored(fresh[k : k + SCORED]) for k in range(0, len(fresh), SCORED)]
        score, size, known = (np.concatenate(x) for x in zip(*found))
        self.scores = np.concatenate([self.scores, score])
        self.letters = np.concatenate([self.letters, size])
        self.known = np.concatenate([self.known, known])

    def _scored(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, letters, and letters in known scripts of some words."""
        plain = letters(words)
        size = np.array([len(w) for w in plain], np.int32)
        score, known = np.zeros((len(words), len(self.model.languages)), np.float32), size.copy()
        some = np.flatnonzero(size)
        if len(some):
            hashed, whose, script = grams([plain[i] for i in some.tolist()])
            logs = self.model.logs[hashed]
            for k in range(score.shape[1]):
                score[some, k] = np.bincount(whose, weights=logs[:, k], minlength=len(some))
            allowed = self.model.written[script]
            foreign = ~allowed.any(axis=1)
            known[some[foreign]] = 0
            allowed[foreign] = True
            score[some] = np.where(allowed, score[some] / len(SIZES), -1e4)
        return score, size, known

    def words(self, texts: tb.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scores and letters of all words of a slice, the number of words of each text, and the letters in known scripts."""
        cut = tb.words(texts)
        number = self.numbers.numbers(texts, cut, self._make, self._clear)
        return self.scores[number], self.letters[number], cut.per_doc(len(texts)), self.known[number]


_scorers: dict[bytes, Scorer] = {}


def scorer(model: Model) -> Scorer:
    """This worker's scorer of a model; only the latest model's is kept."""
    key = model.key()
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model)
    return _scorers[key]


def viterbi(scores: np.ndarray, n_words: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every word; texts lie one after another in ``scores``."""
    begin = np.cumsum(n_words) - n_words
    order = np.argsort(-n_words, kind="stable")
    begin, size = begin[order], n_words[order]
    label = np.zeros(len(scores), np.int16)
    if not len(scores):
        return label
    # how many texts have a word at each place
    alive = len(size) - np.searchsorted(size[::-1], np.arange(int(size[0])), side="right")
    came = np.zeros(len(scores), np.int16)  # the best label before each word, for words that changed
    changed = np.zeros(scores.shape, bool)
    value = scores[begin[: alive[0]]].copy()
    final = np.zeros(len(size), np.int16)
    for t in range(1, len(alive)):
        n = alive[t]
        if n < len(value):
            final[n : len(value)] = value[n:].argmax(axis=1)
            value = value[:n]
        at = begin[:n] + t
        best = value.argmax(axis=1)
        other = value[np.arange(n), best] - penalty
        move = value < other[:, None]
        came[at], changed[at] = best, move
        value = np.where(move, other[:, None], value) + scores[at]
    final[: len(value)] = value.argmax(axis=1)
    now = final
    for t in range(len(alive) - 1, -1, -1):
        n = alive[t]
        at = begin[:n] + t
        label[at] = now[:n]
        move = changed[at, now[:n]]
        now[:n] = np.where(move, came[at], now[:n])
    return label


def learn(documents: DataFrame, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of documents with a language that are not held out."""
    ship(documents.sparkSession)
    d = documents.select(documents[id_col].alias("id"), documents[text_col].alias("text"), documents[lang_col].alias("lang"))
    known = d.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id"), PARTS, PART))

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang in set(batch.column(1).to_pylist()):
                own = batch.filter(pa.compute.equal(batch.column(1), lang))
                sums = total.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS) + 1, np.int64))
                for texts in tb.slices(own.column(0), tb.SMALL_SLICE_BYTES):
                    cut = tb.words(texts)
                    _, first, count = np.unique(tb.hashes(texts, cut), return_index=True, return_counts=True)
                    for at, times in ((first[k : k + SCORED], count[k : k + SCORED]) for k in range(0, len(first), SCORED)):
                        plain = letters([texts.data[a:b].tobytes() for a, b in zip(cut.start[at].tolist(), cut.end[at].tolist())])
                        some = [i for i, w in enumerate(plain) if w]
                        if some:
                            hashed, whose, script = grams([plain[i] for i in some])
                            times = times[some]
                            sums[:BUCKETS] += np.bincount(hashed, weights=times[whose], minlength=BUCKETS).astype(np.int64)
                            sums[BUCKETS:] += np.bincount(script, weights=times * np.array([len(plain[i]) for i in some]), minlength=len(SCRIPTS) + 1).astype(np.int64)
        for lang, sums in total.items():
            place = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(place), pa.string()), pa.array(place, pa.int32()), pa.array(sums[place])], ["lang", "place", "n"])

    counts = sampled_of_each(known, "id", "lang", most).select("text", "lang").mapInArrow(run, "lang string, place int, n long")
    got = counts.groupBy("lang", "place").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS + scripts a language
    languages = sorted(set(got["lang"]))
    n = np.zeros((BUCKETS + len(SCRIPTS) + 1, len(languages)))
    n[got["place"], got["lang"].map({x: k for k, x in enumerate(languages)}).to_numpy(int)] = got["n"]
    grams_, written = n[:BUCKETS], n[BUCKETS:]
    logs = np.log((grams_ + 0.1) / (grams_.sum(axis=0) + 0.1 * BUCKETS))
    return Model(languages, logs.astype(np.float32), written > 0.01 * np.maximum(written.sum(axis=0), 1))


def identify(documents: DataFrame, model: Model, with_spans: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred``, ``score`` and (``with_spans``) ``spans``: (first word, last word, language) from 0."""
    ship(documents.sparkSession)
    kind = documents.schema[id_col].dataType.simpleString()
    names = np.array([*model.languages, "und"], object)
    names_, n_langs = ["id", "lang_pred", "score", *["spans"] * with_spans], len(model.languages)
    span = pa.list_(pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("lang", pa.string())]))

    def finish(held):
        keys = pa.concat_arrays([h[0] for h in held])
        scores, size, n_words = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
        n = len(n_words)
        label = viterbi(scores, n_words, model.penalty) if n_langs else np.zeros(len(size), np.int16)
        doc = np.repeat(np.arange(n), n_words)
        share = np.bincount(doc * (n_langs + 1) + label, weights=size, minlength=n * (n_langs + 1)).reshape(n, -1)
        total = share.sum(axis=1)
        best = np.where((total > 0) & (n_langs > 0), share.argmax(axis=1), n_langs)
        score = np.where(best < n_langs, share[np.arange(n), best] / np.maximum(total, 1), 0.0)
        out = [keys, pa.array(names[best], pa.string()), pa.array(score)]
        if with_spans:
            new = np.ones(len(label), bool)
            new[1:] = (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(label)) - 1 if len(first) else first
            before = (np.cumsum(n_words) - n_words)[doc[first]]
            parts = [pa.array((first - before).astype(np.int32)), pa.array((last - before).astype(np.int32)), pa.array(names[label[first]] if n_langs else ["und"] * len(first), pa.string())]
            at = np.append(0, np.cumsum(np.bincount(doc[first], minlength=n)))
            out.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(span.value_type))))
        yield pa.RecordBatch.from_arrays(out, names_)

    def run(batches):
        own, held, words = scorer(model), [], 0
        for batch in batches:
            for texts in tb.slices(batch.column(1), tb.SMALL_SLICE_BYTES):
                held.append((batch.column(0).slice(texts.first, len(texts)), *own.words(texts)))
                words += len(held[-1][1])
                if words >= TOGETHER:
                    yield from finish(held)
                    held, words = [], 0
        if held:
            yield from finish(held)

    schema = f"id {kind}, lang_pred string, score double" + ", spans array<struct<first_word: int, last_word: int, lang: string>>" * with_spans
    return documents.select(documents[id_col].alias("id"), documents[text_col].alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def accepted(documents: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, of which ``least`` of the letters are in one language.

    Letters of words in a script that no learned language is written in are in none.
    """
    ship(documents.sparkSession)
    place = documents.columns.index(text_col)

    def share(held):
        scores, size, n_words, known = (np.concatenate([h[k] for h in held]) for k in range(4))
        label = viterbi(scores, n_words, model.penalty)
        n, n_langs = len(n_words), scores.shape[1]
        doc = np.repeat(np.arange(n), n_words)
        letters_ = np.bincount(doc * n_langs + label, weights=known, minlength=n * n_langs).reshape(n, n_langs)
        return letters_.max(axis=1) / np.maximum(np.bincount(doc, weights=size, minlength=n), 1)

    def run(batches):
        own = scorer(model)
        for batch in batches:
            found, held, words = [np.zeros(0)], [], 0
            for texts in tb.slices(batch.column(place), tb.SMALL_SLICE_BYTES):
                held.append(own.words(texts))
                words += len(held[-1][1])
                if words >= TOGETHER:
                    found.append(share(held))
                    held, words = [], 0
            if held:
                found.append(share(held))
            yield batch.filter(pa.array(np.concatenate(found) >= least))

    return documents.mapInArrow(run, documents.schema) if model.languages else documents.limit(0)


def predict(documents: DataFrame, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id_col``, ``held_out``, ``lang_pred``, ``score`` of every document."""
    out = identify(documents, learn(documents, most, id_col, text_col, lang_col), False, id_col, text_col)
    return out.select(id_col, held_out(F.col(id_col), PARTS, PART).alias("held_out"), "lang_pred", "score")
