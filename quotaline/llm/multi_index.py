"""Approximate nearest neighbours by inner product: an inverted multi-index.

Vectors are cut in two halves and each half is quantised on its own, to one of ``centroids`` means. A vector's cell is
its pair of means; every vector is listed in its cell. For a query, the means of both halves are sorted by the inner
product that a vector near them may have with the query: that of the mean, and ``REACH`` times the usual size of what
the vectors differ from it, so that cells of long vectors, which scatter more, come early enough. A heap walks the pairs
of means by the sum of both until the cells seen hold ``share`` of all vectors (and ``at_least`` of them). The entries of
those cells are reranked by their inner product with the query. Vectors need not have the same length.

The means are fitted on a sample of at most about ``sample`` vectors, chosen by a hash of the id; all vectors are
listed. Entry blocks hold a run of cells, or a part of a cell with many entries, so no cell is ever in one task; query
blocks meet only the entry blocks that one of their queries walks to. The driver holds the means and the number of
entries per cell, at most ``centroids`` squared per dimension of the sample; dimensions that the sample lacks have one
cell. Measured recall against brute force is in the README.

Null, zero, non-finite or empty vectors and rows without id take no part; rows that repeat an id count once, with the
smallest of their vectors; vectors of different dimensions do not meet; other columns are ignored. An empty table, or
one without queries, gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotaline.llm import vectors as V
from quotaline.llm.shared import cut, ship

BLOCK = 2048
QUERIES = 512
#: Scored pairs that a task holds before it cuts them to each query's best.
MERGED = 1_000_000
#: Standard deviations that a vector may lie beyond its mean, in the query's direction.
REACH = 2.0


def means(points: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """``k`` means of some points (fewer, if there are fewer different points)."""
    different = np.unique(points, axis=0)
    rng = np.random.default_rng(seed)
    if len(different) <= k:
        return different
    centre = different[rng.choice(len(different), k, replace=False)]
    for _ in range(rounds):
        near = nearest(points, centre)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(centre)
        np.add.at(total, near, points)
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], different[rng.choice(len(different), k)])
    return centre


def distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances, less each point's own square."""
    return (centre**2).sum(axis=1) - 2 * points @ centre.T


def nearest(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return distances(points, centre).argmin(axis=1)


def scatter(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """For each mean the standard deviation, in any one direction, of the points nearest to it."""
    near = nearest(points, centre)
    square = np.bincount(near, weights=((points - centre[near]) ** 2).sum(axis=1), minlength=len(centre))
    return np.sqrt(square / np.maximum(np.bincount(near, minlength=len(centre)), 1) / max(points.shape[1], 1))


def farness(q: np.ndarray, centre: np.ndarray, scattered: np.ndarray) -> np.ndarray:
    """Less for means whose vectors may have a larger inner product with each query; adds up over halves."""
    return -(q @ centre.T) - REACH * np.linalg.norm(q, axis=1)[:, None] * scattered


def walk(first: np.ndarray, second: np.ndarray, entries: np.ndarray, wanted: int) -> list[int]:
    """Cells in order of summed farness until they hold ``wanted`` entries; ``entries`` is per pair of means."""
    i_order, j_order = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = first[i_order].tolist(), second[j_order].tolist()
    i_, j_, size = i_order.tolist(), j_order.tolist(), entries.tolist()
    heap, cells, held = [(a[0] + b[0], 0, 0)], [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = i_[i] * len(b) + j_[j]
        if size[cell]:
            cells.append(cell)
            held += size[cell]
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if not j and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return cells


class Index:
    """The means of every dimension, and after `place` how many entries each cell has and in which blocks they are."""

    def __init__(self, sample: dict[int, np.ndarray], centroids: int):
        self.means = {dim: (means(x[:, : dim // 2], centroids), means(x[:, dim // 2 :], centroids)) for dim, x in sample.items()}
        self.scattered = {dim: (scatter(x[:, : dim // 2], self.means[dim][0]), scatter(x[:, dim // 2 :], self.means[dim][1])) for dim, x in sample.items()}

    def cells(self, dim: int, x: np.ndarray) -> np.ndarray:
        if dim not in self.means:
            return np.zeros(len(x), np.int64)
        first, second = self.means[dim]
        return nearest(x[:, : dim // 2], first) * len(second) + nearest(x[:, dim // 2 :], second)

    def place(self, counts: dict[tuple[int, int], int], block: int) -> None:
        """Deal cells to blocks of about ``block`` entries: ``at`` has each cell's first block and its number of them."""
        self.counts, self.at, self.n_blocks, held = counts, {}, 0, 0
        last = None
        for (dim, cell), n in sorted(counts.items()):
            if n > block or dim != last or held + n > block:
                self.n_blocks, held = self.n_blocks + 1, 0
            parts = math.ceil(n / block)
            self.at[dim, cell] = (self.n_blocks - 1, parts)
            self.n_blocks, held, last = self.n_blocks + parts - 1, held + n if parts == 1 else block, dim

    def probes(self, dim: int, q: np.ndarray, share: float, at_least: int) -> list[list[int]]:
        """The cells to look into for each query."""
        n = sum(m for (d, _), m in self.counts.items() if d == dim)
        if dim not in self.means:
            return [[0]] * len(q)
        first, second = self.means[dim]
        entries = np.zeros(len(first) * len(second), np.int64)
        for (d, cell), m in self.counts.items():
            if d == dim:
                entries[cell] = m
        s1, s2 = self.scattered[dim]
        d1, d2 = farness(q[:, : dim // 2], first, s1), farness(q[:, dim // 2 :], second, s2)
        return [walk(x, y, entries, max(math.ceil(share * n), at_least)) for x, y in zip(d1, d2)]


def _rows(batch, name: str, dim: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _merged(held: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's ``k`` best of some arrays of query, other and score."""
    query, other, score = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((other, -score, query))
    query, other, score = query[order], other[order], score[order]
    top = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[top], other[top], score[top]


def _rerank(k: int):
    def run(batches):
        """The best of all blocks of a task, so that rows do not grow with the number of blocks."""
        held, size, most = [], 0, MERGED
        for batch in batches:
            for r in range(batch.num_rows):
                dim = batch.column(batch.schema.get_field_index("dim"))[r].as_py()
                ids, others, cells, sizes, members, here = (V.matrix(batch, c, r, np.int64) for c in ("ids", "e_ids", "cells", "sizes", "members", "e_cells"))
                q, e = (V.matrix(batch, c, r, np.float64).reshape(-1, dim) for c in ("vecs", "e_vecs"))
                score = np.full((len(q), len(e)), -np.inf)
                for cell, begin, count in zip(cells.tolist(), (np.cumsum(sizes) - sizes).tolist(), sizes.tolist()):
                    a, b = np.searchsorted(here, [cell, cell + 1]).tolist()
                    who = members[begin : begin + count]
                    score[who, a:b] = q[who] @ e[a:b].T
                score[ids[:, None] == others[None, :]] = -np.inf
                m = min(k, len(e))
                edge = np.partition(score, len(e) - m, axis=1)[:, len(e) - m]
                # all that may be among the best, scored again in one fixed order of addition
                row, c = np.nonzero((score >= edge[:, None] - 1e-9 * np.maximum(1, np.abs(edge))[:, None]) & (score > -np.inf))
                exact = np.einsum("ij,ij->i", q[row], e[c])
                held.append((ids[row], others[c], exact))
                size += len(row)
                if size > most:
                    held = [_merged(held, k)]
                    size = len(held[0][0])
                    if size > most // 2:  # more queries than a task should hold: hand over what there is
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["query_id", "id", "score"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _merged(held, k)], ["query_id", "id", "score"])

    return run


def search(
    vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 20, centroids: int = 32, share: float = 0.6, at_least: int = 2000,
    sample: int = 10_000, id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank``, ``id_col``, ``score``: each query's ``k`` nearest found, by inner product in doubles.

    ``is_query`` tells queries by their id; a query's own row is no candidate.
    """
    ship(vectors.sparkSession)
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = V.usable(vectors, id_col, vec_col, lambda x: x).where(F.exists("vec", lambda x: x != 0))
    rows = cut(rows.select("id", "vec", "dim"))
    n, n_queries = rows.agg(F.count("*"), F.count(F.when(is_query(F.col("id")), 1))).first()
    drawn = rows.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) < int(1e6 * sample / max(n, 1))) if n > sample else rows
    by_dim: dict[int, list] = {}
    for vec, dim in drawn.select("vec", "dim").orderBy("id").collect():  # about ``sample`` rows
        by_dim.setdefault(dim, []).append(vec)
    index = Index({dim: np.array(x) for dim, x in by_dim.items()}, centroids)

    def assign(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy()
            cell = np.zeros(len(dims), np.int64)
            for dim in np.unique(dims).tolist():
                which = dims == dim
                cell[which] = index.cells(dim, _rows(batch.filter(pa.array(which)), "vec", dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["id", "vec", "dim", "cell"])

    listed = cut(rows.mapInArrow(assign, "id long, vec array<double>, dim int, cell long"))
    index.place({(dim, cell): m for dim, cell, m in listed.groupBy("dim", "cell").count().collect()}, BLOCK)  # at most centroids**2 a dimension

    def deal(batches):
        for batch in batches:
            at = [index.at[d, c] for d, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            first, parts = np.array(at, np.int64).reshape(-1, 2).T
            part = batch.column(4).to_numpy() % parts
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array((first + part).astype(np.int32))], ["id", "vec", "dim", "cell", "block"])

    # within a block, rows are in order of cell, so that a cell is a run
    salted = listed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(1 << 20)))
    dealt = salted.mapInArrow(deal, "id long, vec array<double>, dim int, cell long, block int")
    packed = F.sort_array(F.collect_list(F.struct("cell", "id", "vec")))
    entries = dealt.groupBy("dim", "block").agg(packed.alias("rows")).select(F.col("block").alias("e_block"), F.col("rows.cell").alias("e_cells"), F.col("rows.id").alias("e_ids"), F.flatten("rows.vec").alias("e_vecs"))

    def probe(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                dim = batch.column(0)[r].as_py()
                ids, q = V.matrix(batch, "ids", r, np.int64), V.matrix(batch, "vecs", r, np.float64).reshape(-1, dim)
                wanted: dict[int, dict[int, list[int]]] = {}
                for i, cells in enumerate(index.probes(dim, q, share, at_least)):
                    for cell in cells:
                        first, parts = index.at[dim, cell]
                        for b in range(first, first + parts):
                            wanted.setdefault(b, {}).setdefault(cell, []).append(i)
                for b, by_cell in wanted.items():  # a row per block that is walked to
                    cells = sorted(by_cell)
                    yield pa.RecordBatch.from_pydict({
                        "dim": [dim], "e_block": [b], "ids": [ids], "vecs": [q.ravel()], "cells": [cells],
                        "sizes": [[len(by_cell[c]) for c in cells]], "members": [[i for c in cells for i in by_cell[c]]],
                    }, schema=probed)

    longs = pa.list_(pa.int64())
    probed = pa.schema([("dim", pa.int32()), ("e_block", pa.int32()), ("ids", longs), ("vecs", pa.list_(pa.float64())), ("cells", longs), ("sizes", longs), ("members", longs)])
    queries = V.blocks(V.numbered(rows.where(is_query(F.col("id"))), max(1, math.ceil(n_queries / QUERIES)))).select("dim", "ids", "vecs")
    walks = queries.mapInArrow(probe, "dim int, e_block int, ids array<long>, vecs array<double>, cells array<long>, sizes array<long>, members array<long>")

    found = walks.join(entries, "e_block").mapInArrow(_rerank(k), "query_id long, id long, score double")
    return V.best(found, k).select(F.col("query_id").cast(kind), F.col("rank").cast("int"), F.col("id").cast(kind).alias(id_col), "score")
