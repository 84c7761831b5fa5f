"""Phrase collocations by best-first branch and bound over prefixes.

A candidate is a phrase of two or three words that occurs ``least`` times or more in a language; its score is the lowest
``floor(1000000 * a * a / (l * r))`` over the places where it can be cut in two, ``a``, ``l`` and ``r`` being the counts of
the phrase and of both parts. A candidate goes if a longer one that holds its words occurs at least half as often. Wanted
are the ``top`` highest scores of each language that stay.

1. A pass counts words, another the pairs of words that both occur often enough: no other pair can.
2. Each pair is a prefix that may grow by a word. Its longest extension occurs ``m`` times at most, the smaller of the
   pair's own count and the highest count of a pair that begins with its second word; so no phrase grown from it scores
   more than ``1000000 * m / f(first word)``. Prefixes are the frontier, the highest bounds first.
3. A wave expands the frontier down to a bound: at first the score that ``AHEAD * top`` pairs of a language reach. A pass
   over the texts counts the extensions of those prefixes, and of the pairs with such scores also what precedes them, as
   either may drop a pair. Now all that scores so much is known, and whether it stays.
4. Where ``top`` phrases stay, the rest of the frontier is bounded by less than the last of them, ties included: the
   language is settled. Elsewhere the bound falls to what four times as many pairs reach, until nothing is left.

Counting is by hashes of words, 64 bits each, and of languages; counts meet in the task first, are handed on when many,
and are summed by Spark. Which prefixes a wave expands is told to tasks by bit maps of a fixed size (``BITS``): where they
take a phrase for an open one by mistake, it is counted without need. Arithmetic is exact (38 digits). The driver holds
the bit maps and a few numbers a language.

A null text is empty, a null language ``und``. Every row counts, repeated ones too. Only A-Z are lower-cased; texts are
cut at ``.,;:!?`` and line ends, and words at spaces and tabs. Ties go to the higher count, then to the phrase that sorts
first by its bytes. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotaline.llm import textbatch as tb
from quotaline.llm.components import spread
from quotaline.llm.shared import cut, ship

#: Size of the bit maps, as a power of two: 8 MB.
BITS = 26
#: Rows of counts that a task holds before it puts equal ones together, and those that it then hands on.
HELD, HANDED = 400_000, 200_000
#: Text worked on at once: half of other operators', for the columns of its runs of words lie beside it.
SLICE_BYTES = 1 << 20
#: The first wave goes down to the score that so many times the wanted number of pairs reach; later ones four times as far.
AHEAD = 2
_U = np.uint64
_BREAK, _SOLID = np.zeros(256, bool), np.ones(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_SOLID[[*b".,;:!?", 10, 11, 12, 13, 32, 9]] = False
_MIX = np.random.default_rng(20_250_611).integers(1, 1 << 63, 5, dtype=np.uint64) * _U(2) + _U(1)


def words(texts: tb.Texts) -> tuple[tb.Pieces, np.ndarray]:
    """The words of a slice, and whether each goes on the piece of the one before."""
    solid = np.zeros(len(texts.data) + 2, bool)
    solid[1:-1] = _SOLID[texts.data]
    edge = np.zeros(len(texts.data) + 1, bool)
    edge[texts.offsets] = True
    start = np.flatnonzero(solid[1:] & (~solid[:-1] | edge))
    end = np.flatnonzero(solid[:-1] & (~solid[1:] | edge))
    doc = np.searchsorted(texts.offsets, start, side="right") - 1
    breaks = np.cumsum(_BREAK[texts.data])[start] if len(start) else np.zeros(0, np.int64)
    follows = np.zeros(len(start), bool)
    follows[1:] = (doc[1:] == doc[:-1]) & (breaks[1:] == breaks[:-1])
    return tb.Pieces(start, end, doc), follows


def _key(columns: list[np.ndarray]) -> np.ndarray:
    total = np.zeros(len(columns[0]), np.uint64)
    for k, c in enumerate(columns):
        total += c.view(np.uint64) * _MIX[k]
    return tb.mix(total)


def slots(columns: list[np.ndarray], size: int) -> np.ndarray:
    """Places in a bit map of ``2**size`` bits."""
    return (_key(columns) >> _U(64 - size)).astype(np.int64)


def holds(bits: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    at = slots(columns, len(bits).bit_length() + 2)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def grouped(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct rows, their summed counts, and a place where each stands."""
    key = _key(columns)
    order = np.argsort(key)
    new = np.ones(len(order), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    differs = np.zeros(len(order), bool)
    for c in columns:
        differs[1:] |= c[order][1:] != c[order][:-1]
    if (differs & ~new).any():  # different rows with one key
        order = np.lexsort(columns)
        for c in columns:
            new[1:] |= c[order][1:] != c[order][:-1]
    at = np.flatnonzero(new)
    first = order[at]
    return [c[first] for c in columns], np.add.reduceat(counts[order], at), first


class Counts:
    """Counts of rows of numbers (and a text that goes with each), handed on in batches when they are many."""

    def __init__(self, names: list[str], worded: bool, most: tuple[int, int]):
        self.names, self.worded, self.most = names, worded, most
        self.held: list[tuple] = []
        self.rows = 0

    def add(self, columns: list[np.ndarray], text=None):
        """Take in rows; ``text`` gives the texts of chosen rows."""
        if not len(columns[0]):
            return
        some, counts, first = grouped(columns, np.ones(len(columns[0]), np.int64))
        self.held.append((some, counts, text(first) if self.worded else None))
        self.rows += len(counts)
        if self.rows > self.most[0]:
            yield from self.merged(self.most[1])

    def merged(self, most: int = 0):
        if not self.held:
            return
        columns = [np.concatenate(c) for c in zip(*(h[0] for h in self.held))]
        some, counts, first = grouped(columns, np.concatenate([h[1] for h in self.held]))
        texts = np.concatenate([h[2] for h in self.held])[first] if self.worded else None
        self.held, self.rows = [(some, counts, texts)], len(counts)
        if self.rows > most:
            arrays = [*(pa.array(c.view(np.int64)) for c in some), *([pa.array(texts, pa.string())] if self.worded else []), pa.array(counts)]
            self.held, self.rows = [], 0
            yield pa.RecordBatch.from_arrays(arrays, self.names)


def _count(order: int, most: tuple[int, int], often=None, near=None, among: set[int] | None = None):
    """Count the runs of ``order`` words: all; those of two words in ``often``; or those whose first and last two words
    are in ``often`` and one of these pairs in ``near``. Bit maps are broadcast."""

    def run(batches):
        counts = Counts(["g", *"xyz"[:order], *["word"] * (order == 1), "n"], order == 1, most)
        for batch in batches:
            language = batch.column(0).to_numpy()
            asked = None if among is None else np.isin(language, list(among))
            for texts in tb.slices(batch.column(1), SLICE_BYTES):
                low = texts.lowered()
                cut_, follows = words(low)
                g = language[texts.first + cut_.doc]
                h = tb.hashes(low, cut_).view(np.int64)
                if asked is not None:
                    follows &= asked[texts.first + cut_.doc]
                if order == 1:
                    data = low.data.tobytes()
                    spell = lambda at: np.array([data[a:b].decode("utf-8") for a, b in zip(cut_.start[at].tolist(), cut_.end[at].tolist())], object)  # noqa: B023, E731
                    yield from counts.add([g, h], spell)
                    totals = np.zeros(len(g), np.int64)  # a row for each language: all its words
                    yield from counts.add([g, totals], lambda at: np.full(len(at), "", object))
                    continue
                if order == 2:
                    good = holds(often.value, [g, h])
                    at = np.flatnonzero(follows[1:] & good[1:] & good[:-1])
                else:
                    two = np.flatnonzero(follows[1:])
                    columns = [g[two], h[two], h[two + 1]]
                    good, close = np.zeros(len(g), bool), np.zeros(len(g), bool)
                    good[two] = holds(often.value, columns)
                    close[two] = holds(near.value, columns)
                    at = np.flatnonzero(good[:-1] & good[1:] & (close[:-1] | close[1:]))
                yield from counts.add([g[at], *(h[at + k] for k in range(order))])
        yield from counts.merged()

    return run


def bit_map(rows: DataFrame, size: int) -> np.ndarray:
    """A bit map of rows of numbers; ``2**size / 8`` bytes come to the driver, whatever the rows."""

    def run(batches):
        for batch in batches:
            at = np.unique(slots([c.to_numpy() for c in batch.columns], size))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 15), pa.array(at & 32767)], ["bucket", "bit"])

    found = rows.mapInArrow(run, "bucket long, bit long").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros((1 << size - 15, 4096), np.uint8)
    for r in found.toLocalIterator():
        out[r["bucket"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def score(a: str, l: str, r: str) -> Column:  # noqa: E741
    """``floor(1000000 * a * a / (l * r))``, in 64 bits where they hold it and in 38 digits elsewhere."""
    wide = f"(1000000 * CAST({a} AS DECIMAL(20, 0)) * {a}) div (CAST({l} AS DECIMAL(19, 0)) * CAST({r} AS DECIMAL(19, 0)))"
    return F.expr(f"CASE WHEN {a} < 3000000 AND greatest({l}, {r}) < 3000000000 THEN (1000000 * {a} * {a}) div ({l} * {r}) ELSE {wide} END")


def thresholds(pairs: DataFrame, want: int, among: set[int] | None) -> dict[int, int]:
    """Of each language the score that about ``want`` of its pairs reach, 0 if it has fewer.

    Scores are counted by their ten highest bits, so a language has a few thousand counts, and the driver a number.
    """
    rows = pairs if among is None else pairs.where(F.col("g").isin(list(among)))
    rough = rows.withColumn("low", F.expr("greatest(0, length(bin(score)) - 10)")).select("g", F.expr("shiftleft(shiftright(score, low), low)").alias("s"))
    above = F.sum("n").over(Window.partitionBy("g").orderBy(F.col("s").desc()))
    counted = rough.groupBy("g", "s").agg(F.count("*").alias("n")).withColumn("upto", above)
    return {r["g"]: r["s"] or 0 for r in counted.groupBy("g").agg(F.max(F.when(F.col("upto") >= want, F.col("s"))).alias("s")).collect()}


class Miner:
    """The tables of a corpus that waves work on: words, and pairs with their scores and bounds."""

    def __init__(self, documents: DataFrame, least: int, text_col: str = "text", lang_col: str = "lang", bits: int = BITS, most: tuple[int, int] = (HELD, HANDED)):
        ship(documents.sparkSession)
        self.spark, self.least, self.bits, self.most = documents.sparkSession, least, bits, most
        lang = F.coalesce(documents[lang_col].cast("string"), F.lit("und"))
        self.texts = documents.select(F.xxhash64(lang).alias("g"), documents[text_col].alias("text"))
        self.langs = documents.select(lang.alias("lang")).distinct().withColumn("g", F.xxhash64("lang"))
        found = self.texts.mapInArrow(_count(1, most), "g long, x long, word string, n long").groupBy("g", "x", "word").agg(F.sum("n").alias("n"))
        found = cut(found.where((F.col("n") >= least) | (F.col("x") == 0)))
        self.totals = found.where("x = 0").select("g", F.col("n").alias("total"))
        self.words = found.where("x <> 0")
        self.often1 = self._shared(self.words.select("g", "x"))
        pairs = self.counted(2, self.often1)
        one = spread(self.words.select("g", "x", "n"))
        for name in "xy":
            pairs = pairs.join(one.select("g", F.col("x").alias(name), F.col("n").alias(f"f{name}")), ["g", name])
        pairs = cut(pairs.select("g", "x", "y", "n", "fx", "fy", score("n", "fx", "fy").alias("score")))
        grows = spread(pairs.groupBy("g", F.col("x").alias("y")).agg(F.max("n").alias("m")))
        bound = F.expr("(1000000 * CAST(least(n, m) AS DECIMAL(20, 0))) div fx")
        self.pairs = cut(pairs.join(grows, ["g", "y"], "left").select(*pairs.columns, F.coalesce(bound, F.lit(-1)).alias("bound")))
        self.often2 = self._shared(self.pairs.select("g", "x", "y"))

    def _shared(self, rows: DataFrame):
        return self.spark.sparkContext.broadcast(bit_map(rows, self.bits))

    def counted(self, order: int, *maps, among: set[int] | None = None) -> DataFrame:
        """The runs of ``order`` words that occur often enough."""
        keys = ["g", *"xyz"[:order]]
        found = self.texts.mapInArrow(_count(order, self.most, *maps, among=among), ", ".join(f"{k} long" for k in [*keys, "n"]))
        return found.groupBy(*keys).agg(F.sum("n").alias("n")).where(F.col("n") >= self.least)

    def wave(self, down_to: dict[int, int]) -> DataFrame:
        """All phrases that score at least ``down_to`` of their language and stay."""
        least = F.create_map(*(F.lit(x) for p in down_to.items() for x in p))[F.col("g")] if down_to else F.lit(None).cast("long")
        near = self.pairs.where((F.col("bound") >= least) | (F.col("score") >= least))
        bits = self._shared(near.select("g", "x", "y"))
        threes = cut(self.counted(3, self.often2, bits, among=set(down_to)))
        two = spread(self.pairs.select("g", "x", "y", "n", "fx", "fy"))
        scored = threes.join(two.select("g", "x", "y", F.col("n").alias("fxy"), "fx"), ["g", "x", "y"])
        scored = scored.join(two.select("g", F.col("x").alias("y"), F.col("y").alias("z"), F.col("n").alias("fyz"), F.col("fy").alias("fz")), ["g", "y", "z"])
        scored = scored.withColumns({"cut1": score("n", "fx", "fyz"), "cut2": score("n", "fxy", "fz")})
        early = F.col("cut1") <= F.col("cut2")
        grown = scored.select(
            "g", "x", "y", "z", F.col("n").alias("a"), F.when(early, F.col("fx")).otherwise(F.col("fxy")).alias("l"), F.when(early, F.col("fyz")).otherwise(F.col("fz")).alias("r"), F.least("cut1", "cut2").alias("score")
        )
        inside = threes.select("g", "x", "y", "n").unionByName(threes.select("g", F.col("y").alias("x"), F.col("z").alias("y"), "n"))
        inside = inside.groupBy("g", "x", "y").agg(F.max("n").alias("longest"))
        open_ = self.pairs.where(F.col("score") >= least)
        stay = open_.join(inside, ["g", "x", "y"], "left").where(F.coalesce(2 * F.col("longest") < F.col("n"), F.lit(True)))
        stay = stay.select("g", "x", "y", F.lit(None).cast("long").alias("z"), F.col("n").alias("a"), F.col("fx").alias("l"), F.col("fy").alias("r"), "score")
        return cut(stay.unionByName(grown.where(F.col("score") >= least)))

    def settled(self, top: int) -> DataFrame | None:
        """The phrases that stay, at least ``top`` of each language if it has so many, and all that score as much."""
        out, open_, want = None, None, AHEAD * top
        while down_to := thresholds(self.pairs, want, open_):
            found = self.wave(down_to)
            have = {r["g"]: r["count"] for r in found.groupBy("g").count().collect()}
            done = [g for g, t in down_to.items() if t == 0 or have.get(g, 0) >= top]
            kept = found.where(F.col("g").isin(done))
            out = kept if out is None else out.unionByName(kept)
            open_, want = set(down_to) - set(done), 4 * want
            if not open_:
                break
        return out


def collocations(documents: DataFrame, top: int = 2000, least: int = 10, text_col: str = "text", lang_col: str = "lang", bits: int = BITS, most: tuple[int, int] = (HELD, HANDED)) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score`` of each language's ``top`` collocations."""
    mined = Miner(documents, least, text_col, lang_col, bits, most)
    found = mined.settled(top)
    if found is None:
        return documents.sparkSession.createDataFrame([], "lang string, rank int, phrase string, a long, l long, r long, n long, score long")
    by_score = Window.partitionBy("g").orderBy(F.col("score").desc(), F.col("a").desc())
    found = found.withColumn("place", F.rank().over(by_score)).where(F.col("place") <= top)  # ties are told by their words
    named = spread(mined.words.select("g", "x", "word"))
    for name, how in (("x", "inner"), ("y", "inner"), ("z", "left")):
        found = found.join(named.select("g", F.col("x").alias(name), F.col("word").alias(f"word_{name}")), ["g", name], how)
    found = found.withColumn("phrase", F.concat_ws(" ", "word_x", "word_y", "word_z"))
    found = found.join(mined.langs, "g").join(mined.totals, "g")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return found.select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
