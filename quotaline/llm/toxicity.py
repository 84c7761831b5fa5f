"""Toxicity of documents: a weighted finite-state grammar over clauses.

Words are symbols: insult, threat, target, negation, reported speech, other. Five small transducers read a clause side
by side: one weighs insults, one raises those near a target, one completes a threat when its target follows, one lowers
what a negation precedes, one lowers what is reported as said by others. They are composed into one weighted automaton
over their reachable product states. Only clauses with an insult or a threat are run; a document's raw score is the sum
of its matched clauses, and a logistic curve turns that and the strongest clause into a score.

The insults' weights come from data: of the words and word beginnings of labelled toxic documents, those are kept whose
log odds against labelled clean ones lie ``CERTAIN`` standard errors above zero and one above ``LEAST_ODDS``. Copies
and near copies, which share one of a few minwise tokens, count as one document there. A few general words are known
from the start. Learning uses at most about ``most`` labelled documents that are not held out, at most ``CANDIDATES`` candidate
beginnings and at most ``LEXICON`` entries; ids, sources, languages and labels are no part of a score.

A null text counts as empty and scores like a text without a match; repeated rows get equal scores; other columns are
ignored; an empty table gives no rows; without labels of both kinds a fixed curve is used.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaline.llm import shingles
from quotaline.llm import textbatch as tb
from quotaline.llm.gam import sigmoid
from quotaline.llm.labelled import held_out, texts_with
from quotaline.llm.shared import ship

PARTS, PART = 3, 1
SAMPLE = 20_000
CANDIDATES = 50_000
LEXICON = 5_000
CERTAIN = 3.0
LEAST_ODDS = 2.0
#: Signature positions that near copies are told by.
TOLD_BY = 4
LEAST_DOCS = 3
BEGINNINGS = range(4, 9)

OTHER, TARGET, NEGATION, REPORT, THREAT, INSULT = range(6)
#: Words known from the start, by symbol.
KNOWN = {
    TARGET: "you your yours yourself u ur he him his she her they them their theirs these those everyone anybody tu vous toi usted ustedes du dich ihr euch",
    NEGATION: "not no never neither nor nobody isn't aren't wasn't weren't don't doesn't didn't won't can't without nicht kein keine niemals pas jamais nunca jamás",
    REPORT: "said says say saying told claims claimed called calls quoted quotes wrote writes reported allegedly according sagte dit dijo",
    THREAT: "kill kills hurt destroy punch beat stab shoot attack burn hang strangle murder töten tuer matar",
    INSULT: "idiot idiots moron morons stupid scum trash loser losers worthless pathetic disgusting imbecile dumb fool vermin filth jerk scumbag idiota estúpido imbécil crétin dummkopf",
}
_SYMBOL = {w: s for s, words in KNOWN.items() for w in words.split()}
KNOWN_WEIGHT = 3.0
_PART = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_ENDS = re.compile(r"[.!?;:…][\"'”’)\]]*$")


@dataclass
class Transducer:
    """``step`` maps (state, symbol) to (state, factor on the symbol's weight, weight added)."""

    start: int
    step: Callable[[int, int], tuple[int, float, float]]


def near(symbol: int, reach: int, factor: float, on: tuple[int, ...]) -> Transducer:
    """Weights of ``on`` are multiplied within ``reach`` symbols after ``symbol``; the state counts down."""
    return Transducer(0, lambda s, x: (reach, 1.0, 0.0) if x == symbol else (max(s - 1, 0), factor if s and x in on else 1.0, 0.0))


def rest_of_clause(symbol: int, factor: float, on: tuple[int, ...]) -> Transducer:
    """Weights of ``on`` are multiplied anywhere after ``symbol``."""
    return Transducer(0, lambda s, x: (1, 1.0, 0.0) if x == symbol else (s, factor if s and x in on else 1.0, 0.0))


def completed(symbol: int, by: int, reach: int, weight: float) -> Transducer:
    """``symbol`` alone weighs nothing; if ``by`` follows within ``reach`` symbols, ``weight`` is added."""
    return Transducer(0, lambda s, x: (reach, 1.0, 0.0) if x == symbol else (0, 1.0, weight) if s and x == by else (max(s - 1, 0), 1.0, 0.0))


def compose(parts: Iterable[Transducer], symbols: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The product automaton's tables over (state, symbol): next state, factor and added weight. State 0 is the start."""
    parts = list(parts)
    number = {tuple(p.start for p in parts): 0}
    rows = []
    for state in (todo := list(number)):
        row = []
        for x in range(symbols):
            steps = [p.step(s, x) for p, s in zip(parts, state)]
            to = tuple(s for s, _, _ in steps)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            # an added weight is lowered like a symbol's own
            factor, added = float(np.prod([f for _, f, _ in steps])), sum(a for _, _, a in steps)
            row.append((number[to], factor, added * (float(np.prod([p.step(s, THREAT)[1] for p, s in zip(parts, state)])) if added else 1.0)))
        rows.append(row)
    table = np.array(rows)
    return table[:, :, 0].astype(int), table[:, :, 1], table[:, :, 2]


def grammar() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return compose([
        Transducer(0, lambda s, x: (0, 1.0, 0.0)),
        near(TARGET, 4, 1.5, (INSULT,)),
        completed(THREAT, TARGET, 4, KNOWN_WEIGHT),
        near(NEGATION, 3, 0.4, (INSULT, THREAT)),
        rest_of_clause(REPORT, 0.6, (INSULT, THREAT)),
    ])


@dataclass
class Model:
    """Learned weights of words and beginnings (with a hyphen), and the logistic curve."""

    weights: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, float, float] = (-3.0, 1.0, 0.5)

    def key(self) -> bytes:
        return hashlib.sha256(repr((sorted(self.weights.items()), self.curve)).encode()).digest()


def features(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *(f"{word[:n]}-" for n in BEGINNINGS if n <= len(word))]


class Scorer:
    """A model's grammar, and the symbols of this worker's distinct words."""

    def __init__(self, model: Model):
        self.model, self.numbers = model, tb.Kept()
        self.to, self.factor, self.added = (t.tolist() for t in grammar())
        self._clear()

    def _clear(self) -> None:
        self.symbol, self.weight, self.ends = np.zeros(0, np.int8), np.zeros(0, np.float64), np.zeros(0, bool)

    def symbol_of(self, text: str) -> tuple[int, float, bool]:
        """Symbol, weight and whether a clause ends after this run of characters."""
        symbol, weight, learned = OTHER, 0.0, self.model.weights
        for part in _PART.findall(text.lower()):
            part = part.replace("’", "'")
            s = _SYMBOL.get(part, OTHER)
            w = max([KNOWN_WEIGHT * (s == INSULT), *(learned[f] for f in features(part) if f in learned)])
            if w > 0 and s in (OTHER, INSULT):
                s = INSULT
            if (s, w) > (symbol, weight):
                symbol, weight = s, w
        return symbol, weight, bool(_ENDS.search(text))

    def _make(self, fresh: list[bytes]) -> None:
        rows = [self.symbol_of(w.decode("utf-8")) for w in fresh]
        self.symbol = np.concatenate([self.symbol, np.array([r[0] for r in rows], np.int8)])
        self.weight = np.concatenate([self.weight, np.array([r[1] for r in rows])])
        self.ends = np.concatenate([self.ends, np.array([r[2] for r in rows], bool)])

    def clause(self, symbols: list[int], weights: list[float]) -> float:
        """The weight of a clause."""
        state, total = 0, 0.0
        for x, w in zip(symbols, weights):
            total += w * self.factor[state][x] + self.added[state][x]
            state = self.to[state][x]
        return total

    def raw(self, texts: tb.Texts) -> np.ndarray:
        """Of every text the sum of its matched clauses' weights and the largest of them."""
        cut = tb.words(texts)
        number = self.numbers.numbers(texts, cut, self._make, self._clear)
        symbol, out = self.symbol[number], np.zeros((len(texts), 2))
        echo = np.zeros(len(number), bool)
        echo[1:] = (number[1:] == number[:-1]) & (cut.doc[1:] == cut.doc[:-1])
        symbol = np.where(echo, OTHER, symbol)  # a word said over and over counts once
        hits = np.flatnonzero(symbol >= THREAT)
        if not len(hits):
            return out
        new = np.ones(len(number), bool)
        new[1:] = self.ends[number[:-1]] | (cut.doc[1:] != cut.doc[:-1])
        first = np.flatnonzero(new)
        begin = np.unique(np.searchsorted(first, hits, side="right") - 1)
        stop = np.append(first[1:], len(number))[begin]
        for a, b in zip(first[begin].tolist(), stop.tolist()):
            score = self.clause(symbol[a:b].tolist(), np.where(echo[a:b], 0, self.weight[number[a:b]]).tolist())
            d = cut.doc[a]
            out[d, 0] += score
            out[d, 1] = max(out[d, 1], score)
        return out

    def score(self, raw: np.ndarray) -> np.ndarray:
        a, b, c = self.model.curve
        return sigmoid(a + b * np.minimum(raw[:, 0], 20) + c * np.minimum(raw[:, 1], 20))


_scorers: dict[bytes, Scorer] = {}


def scorer(model: Model) -> Scorer:
    """This worker's scorer of a model; only the latest model's is kept."""
    key = model.key()
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model)
    return _scorers[key]


def _documents_with(rows: DataFrame, wanted: set[str] | None) -> DataFrame:
    """In how many texts each word or beginning occurs; ``wanted`` ones only, if given."""

    def run(batches):
        total: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen = {f for w in set(_PART.findall((text or "").lower())) for f in features(w.replace("’", "'"))}
                total.update(seen if wanted is None else seen & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["feature", "n"])

    return rows.select("text").mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _without_copies(rows: DataFrame) -> DataFrame:
    """The sampled rows, of near copies only the one with the smallest id."""

    def run(batches):
        for batch in batches:
            for texts in tb.slices(batch.column(1)):
                _, _, signature = shingles.fingerprints(texts)
                keys = [pa.array(signature[:, k].astype(np.int64)) for k in range(TOLD_BY)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first, len(texts)), *keys], ["id", *names])

    names = [f"k{k}" for k in range(TOLD_BY)]
    kind = rows.schema["id"].dataType.simpleString()
    got = rows.select("id", "text").mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} long" for n in names)).toPandas()  # about the sample's size
    seen: list[set[int]] = [set() for _ in names]
    kept = []
    for row in got.sort_values("id").itertuples(index=False):
        if not any(key in s for key, s in zip(row[1:], seen)):
            kept.append((row[0],))
        for key, s in zip(row[1:], seen):
            s.add(key)
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(kept, f"id {kind}")), "id")


def _curve(raw: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float, float]:
    """A logistic curve by Newton's method with halved steps; a slope that would be negative is left at zero."""
    x = np.column_stack([np.ones(len(y)), np.minimum(raw, 20)])
    own, use = np.diag([0.01, ridge, ridge]), [0, 1, 2]

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * w @ own @ w)

    while True:
        w = np.zeros(3)
        for _ in range(50):
            p, part = sigmoid(x @ w), x[:, use]
            step = np.zeros(3)
            step[use] = np.linalg.solve((part * (p * (1 - p))[:, None]).T @ part + own[np.ix_(use, use)], (x.T @ (y - p) - own @ w)[use])
            while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
                step /= 2
            w = w + step
            if np.abs(step).max() < 1e-7:
                break
        if not (bad := [k for k in use[1:] if w[k] < 0]):
            return tuple(w.tolist())
        use.remove(bad[0])


def learn(documents: DataFrame, labels: DataFrame, most: int = SAMPLE, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Weights and curve from labelled documents that are not held out."""
    ship(documents.sparkSession)
    rows = texts_with(documents, labels, label_col, PARTS, PART, most, id_col, text_col)
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return Model()
    single = _without_copies(rows)
    n = {0: 0, 1: 0} | {r["y"]: r["n"] for r in single.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic = _documents_with(single.where("y = 1"), None).where(F.col("n") >= LEAST_DOCS).orderBy(F.desc("n"), "feature").limit(CANDIDATES).toPandas()
    inside = dict(zip(toxic["feature"], toxic["n"]))
    clean = _documents_with(single.where("y = 0"), set(inside)).toPandas()  # at most CANDIDATES rows
    outside = dict(zip(clean["feature"], clean["n"]))
    found = []
    for f, a in inside.items():
        b = outside.get(f, 0)
        odds, error = np.log((a + 0.5) / (n[1] + 1)) - np.log((b + 0.5) / (n[0] + 1)), np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if odds > CERTAIN * error and odds > LEAST_ODDS + error and _SYMBOL.get(f, INSULT) == INSULT:
            found.append((float(odds - error), f))
    model = Model({f: min(w, 6.0) for w, f in sorted(found, reverse=True)[:LEXICON] if w > 0})

    def run(batches):
        own = scorer(model)
        for batch in batches:
            for texts in tb.slices(batch.column(1)):
                raw = own.raw(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first, len(texts)), pa.array(raw[:, 0]), pa.array(raw[:, 1])], ["y", "total", "top"])

    got = rows.select("y", "text").mapInArrow(run, "y int, total double, top double").groupBy("y", "total", "top").count().toPandas()  # at most about ``most`` rows
    got = got.sort_values(["total", "top", "y"]).loc[lambda t: t.index.repeat(t["count"])]
    return Model(model.weights, _curve(got[["total", "top"]].to_numpy(float), got["y"].to_numpy(float)))


def scored(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score`` (0 to 1), ``raw`` (sum of matched clauses) of every row."""
    ship(documents.sparkSession)
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches):
        own = scorer(model)
        for batch in batches:
            for texts in tb.slices(batch.column(1)):
                raw = own.raw(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first, len(texts)), pa.array(own.score(raw)), pa.array(raw[:, 0])], ["id", "score", "raw"])

    return documents.select(documents[id_col].alias("id"), documents[text_col].alias("text")).mapInArrow(run, f"id {kind}, score double, raw double").withColumnRenamed("id", id_col)


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``held_out``, ``score``, ``predicted`` (1 from ``threshold``) of every document."""
    out = scored(documents, learn(documents, labels, most, "toxic", id_col, text_col), id_col, text_col)
    return out.select(id_col, held_out(F.col(id_col), PARTS, PART).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
