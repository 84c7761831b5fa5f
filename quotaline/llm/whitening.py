"""Embedding whitening by shifted CholeskyQR.

Components become integers ``x = floor(scale * c) + offset``; the fit list holds each distinct integer vector once, and
mean, covariance and components are the fit list's. Rows are centred before anything is multiplied: an integer near the
mean is subtracted exactly, then the rest of the mean, so a large offset costs no digits.

1. A distributed pass adds up the Gram matrix of the centred rows (a d x d matrix a task, summed by Spark). Its Cholesky
   factor is taken with a shift that rounding cannot outweigh, so it exists however ill-conditioned the rows are.
2. Further passes send every row through the triangular solves of the factors found so far, one after another, and
   factor the Gram matrix of what comes out, until that is the identity but for rounding. The rows are never stored
   orthogonalised; what grows with the table stays in the tasks, and the driver holds d x d numbers.
3. The product of the factors is the R of the centred rows' QR factorisation. Its singular value decomposition gives the
   components (right singular vectors) and the eigenvalues of the covariance (squared singular values over n): the
   covariance itself, which would square the condition number, is never decomposed.
4. One more pass measures the covariance of the whitened fit list against the identity.

Vectors that are null or empty, or hold null or non-finite components, take no part. Every other row has a result, rows
without id and repeated ones too. Vectors of different lengths are different spaces: each length has its own fit.
Integers are held within 2**52 in size. Components whose standard deviation is below ``LEAST`` of the largest count as
constant and are left out, as no rounding-free direction is left there; a fit list of one vector has none. Other columns
are ignored. Equal eigenvalues have components in no fixed order. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaline.llm.shared import cut, ship

#: Standard deviations below so much of the largest one are rounding.
LEAST = 1e-12
#: The Gram matrix counts as the identity, and this many passes are made at most.
NEAR, PASSES = 1e-11, 8
#: Numbers of a batch that are worked on at once.
NUMBERS = 1 << 20
LARGEST = float(1 << 52)


@dataclass
class Fit:
    """What is known of the vectors of one length."""

    n: int
    sums: list[int]
    factors: list[np.ndarray] = field(default_factory=list)
    components: np.ndarray | None = None
    eigenvalues: np.ndarray | None = None
    trace: float = 0.0
    identity_error: float = 0.0

    def __post_init__(self):
        self.near = np.array([s // self.n for s in self.sums], np.int64)
        self.over = np.array([s % self.n for s in self.sums], object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near).astype(np.float64) - self.over.astype(np.float64) / self.n

    def orthogonalised(self, rows: np.ndarray) -> np.ndarray:
        for r in self.factors:
            rows = solved(rows, r)
        return rows

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components.T / np.sqrt(self.eigenvalues)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n * x - S)**2 over the dimensions, exactly; null beyond a long."""
        away = x - self.near
        most = (int(np.abs(away).max(initial=0)) + 1) * self.n
        if most * most * x.shape[1] < 1 << 62:
            y = away * self.n - self.over.astype(np.int64)
            return (y * y).sum(axis=1).tolist()
        y = away.astype(object) * self.n - self.over
        return [d if d < 1 << 63 else None for d in (y * y).sum(axis=1).tolist()]


def solved(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Rows times the inverse of an upper triangular factor, by substitution."""
    out = np.empty_like(rows)
    for j in range(len(r)):
        out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def factored(gram: np.ndarray, n: int, first: bool) -> np.ndarray:
    """The upper Cholesky factor of a Gram matrix of ``n`` rows, shifted at first and where it would not exist."""
    d = len(gram)
    shift = 11 * (n * d + d * (d + 1)) * 2.0**-53 * max(np.trace(gram), 1e-300)
    shift = min(shift, 1e-3 * max(np.trace(gram), 1e-300))
    least = 0.0 if first else np.linalg.eigvalsh(gram)[0]
    if least < 1e-6 * np.trace(gram) / d:
        gram = gram + shift * np.eye(d)
    return np.linalg.cholesky(gram).T


def integers(vectors: DataFrame, id_col: str, vec_col: str, scale: int, offset: int) -> DataFrame:
    """``id`` and ``x`` of the rows that take part."""
    v = vectors.select(vectors[id_col].alias("id"), vectors[vec_col].cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = v.where((F.size("vec") > 0) & ~F.coalesce(bad, F.lit(True)))
    whole = lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(LARGEST)), F.lit(-LARGEST))) + offset
    return v.select("id", F.transform("vec", whole).alias("x"))


def matrices(batch: pa.RecordBatch, name: str = "x") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of equal length as matrices of bounded size, each with the rows' places in the batch."""
    column = batch.column(batch.schema.get_field_index(name))
    lengths, at = column.value_lengths().to_numpy(), column.offsets.to_numpy()
    flat = column.values.to_numpy()
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        for some in np.array_split(rows, -(-len(rows) * d // NUMBERS)):
            if len(some):
                yield some, flat[at[some][:, None] + np.arange(d)]


def _sums(batches):
    """Rows and sums by length, the sums in two parts that cannot overflow."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for _, x in matrices(batch):
            part = np.stack([(x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0), np.full(x.shape[1], len(x))])
            total[x.shape[1]] = total[x.shape[1]] + part if x.shape[1] in total else part
    for d, (high, low, n) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array(high), pa.array(low), pa.array(n)], ["d", "i", "high", "low", "n"])


def _gram(fits: dict[int, Fit], of: str):
    """The upper triangle of each length's Gram matrix, a task's share, and the sums in a last row."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in matrices(batch):
                if fit := fits.get(x.shape[1]):
                    q = fit.orthogonalised(fit.centred(x)) if of == "rows" else fit.whitened(x)
                    part = np.concatenate([q.T @ q, q.sum(axis=0)[None]])
                    total[x.shape[1]] = total[x.shape[1]] + part if x.shape[1] in total else part
        for d, g in total.items():
            i, j = np.triu_indices(len(g), 0, g.shape[1])
            i, j = np.append(i, np.full(g.shape[1], len(g) - 1)), np.append(j, np.arange(g.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d)), pa.array(i), pa.array(j), pa.array(g[i, j])], ["d", "i", "j", "g"])

    return run


def _grams(fit_list: DataFrame, fits: dict[int, Fit], of: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Gram matrix and sums for each length; the driver gets numbers by dimension only."""
    rows = fit_list.mapInArrow(_gram(fits, of), "d long, i long, j long, g double").groupBy("d", "i", "j").agg(F.sum("g").alias("g")).toArrow()
    d, i, j, g = (rows.column(c).to_numpy() for c in ("d", "i", "j", "g"))
    out = {}
    for length in np.unique(d).tolist():
        at = d == length
        k = int(j[at].max()) + 1
        full = np.zeros((k + 1, k))
        full[i[at], j[at]] = g[at]
        upper = full[:k]
        out[length] = (upper + np.triu(upper, 1).T, full[k])
    return out


def fit(fit_list: DataFrame, components: int) -> dict[int, Fit]:
    """The fit of each length of ``x`` in a list of distinct vectors."""
    sums = fit_list.mapInArrow(_sums, "d long, i long, high long, low long, n long").groupBy("d", "i").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low", "n"))).collect()
    fits: dict[int, Fit] = {}
    for d in sorted({r.d for r in sums}):
        own = sorted((r.i, int(r.high) * (1 << 26) + int(r.low), int(r.n)) for r in sums if r.d == d)
        fits[d] = Fit(own[0][2], [s for _, s, _ in own])
    open_ = dict(fits)
    for k in range(PASSES):
        if not open_:
            break
        grams = _grams(fit_list, open_, "rows")
        for d, (gram, _) in grams.items():
            if k == 0 and not np.trace(gram):  # all rows are alike
                open_.pop(d)
            elif k and np.abs(gram - np.eye(d)).max() <= NEAR:
                open_.pop(d)
            else:
                fits[d].factors.append(factored(gram, fits[d].n, k == 0))
    for d, f in fits.items():
        r = np.eye(d) if f.factors else np.zeros((d, d))
        for factor in f.factors:
            r = factor @ r
        _, s, v = np.linalg.svd(r)
        f.trace = float((r * r).sum() / f.n)
        keep = np.flatnonzero(s > LEAST * s[0])[:components]
        sign = np.sign(v[keep, np.abs(v[keep]).argmax(axis=1)])
        f.components, f.eigenvalues = v[keep] * sign[:, None], s[keep] ** 2 / f.n
    some = {d: f for d, f in fits.items() if len(f.eigenvalues)}
    for d, (gram, sums_) in (_grams(fit_list, some, "whitened") if some else {}).items():
        n, k = fits[d].n, len(gram)
        fits[d].identity_error = float(np.abs(gram / n - np.outer(sums_, sums_) / n**2 - np.eye(k)).max())
    return fits


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64, offset: int = 1_000_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id_col``, ``n``, ``deviation``, ``whitened`` and ``explained`` (a number per component), ``identity_error`` of every row that takes part."""
    ship(vectors.sparkSession)
    rows = integers(vectors, id_col, vec_col, scale, offset)
    fits = fit(cut(rows.select("x").distinct()), components)
    kind = vectors.schema[id_col].dataType.simpleString()
    names = ["id", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches):
        for batch in batches:
            for some, x in matrices(batch):
                f = fits[x.shape[1]]
                w = f.whitened(x)
                k = w.shape[1]
                at = pa.array(np.arange(len(some) + 1) * k, pa.int32())
                share = np.tile(f.eigenvalues / f.trace if k else f.eigenvalues, len(some))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(some)), pa.array(np.full(len(some), f.n)), pa.array(f.deviation(x), pa.int64()), *(pa.ListArray.from_arrays(at, pa.array(y)) for y in (w.ravel(), share)), pa.array(np.full(len(some), f.identity_error))],
                    names,
                )

    schema = f"id {kind}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def by_component(whitened: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """A row for each row and component, numbered from 1."""
    pairs = F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "c")
    out = whitened.select(id_col, "n", "deviation", "identity_error", pairs)
    return out.select(id_col, (F.col("k") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
