"""Exact top-k by inner product: distributed histogram selection.

Scores are integers. For every query an interval is kept that holds its k-th highest score, at first the interval that
the vectors' lengths allow. A pass scores every row against every query, block by block, and counts each query's scores
in ``BINS`` equal bins of its interval; the counts are summed over all blocks, and the bin with the k-th score is the
next interval. When intervals are single values, a last pass keeps the scores above it, and of those equal to it the
smallest ids that are still wanted. Within a block, bins below its own k-th score cannot hold the k-th of all and are
left out, as are ties beyond the wanted number; both are exact.

Vectors of different dimensions do not meet. Null, non-finite or empty vectors and rows without id take no part; rows
that repeat an id count once, with the smallest of their vectors; scores are exact up to 2**61 in size. Other columns
are ignored. An empty table, or one without queries, gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotaline.llm import vectors as V
from quotaline.llm.shared import cut, ship

BINS = 256
BLOCK = 2048


def _scores(batch, row: int, bound: float) -> np.ndarray:
    """The scores of a pair of blocks; the bound on their size says which kind of number holds them exactly."""
    dim = batch.column(batch.schema.get_field_index("dim"))[row].as_py()
    dtype = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    q, e = (V.matrix(batch, f"{side}_vecs", row, np.float64 if dtype is not np.int64 else np.int64).astype(dtype, copy=False).reshape(-1, dim) for side in "qe")
    return (q @ e.T).astype(np.int64)


def top_k(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``id_col``, ``score``: the ``k`` highest inner products of ``floor(scale * x)`` vectors.

    ``is_query`` tells queries by their id; a query's own row is no candidate.
    """
    ship(vectors.sparkSession)
    rows = V.usable(vectors, id_col, vec_col, lambda x: F.floor(x * scale))
    rows = cut(rows.withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x))))
    n, longest, n_queries, longest_query = rows.agg(F.count("*"), F.max("norm"), F.count(F.when(is_query(F.col("id")), 1)), F.max(F.when(is_query(F.col("id")), F.col("norm")))).first()
    n_entry, n_query = max(1, math.ceil(n / BLOCK)), max(1, math.ceil(n_queries / BLOCK))
    bound = (longest or 0.0) * (longest_query or 0.0)
    entries = cut(V.blocks(V.numbered(rows, n_entry)))
    queries = V.numbered(rows.where(is_query(F.col("id"))), n_query)
    reach = F.least(F.col("norm") * (longest or 0.0) * 1.000001, F.lit(2.0**61)).cast("long") + 2
    state = queries.select("id", "dim", "block", "vec", (-reach).alias("low"), reach.alias("high"), F.lit(k).cast("long").alias("need"))
    kind = vectors.schema[id_col].dataType.simpleString()

    def paired(now: DataFrame) -> DataFrame:
        return V.pairs(V.blocks(now, "low", "high", "need"), entries, n_query, n_entry)

    def own(ids: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a query meets its own row."""
        at = np.minimum(np.searchsorted(others, ids), len(others) - 1)
        same = np.flatnonzero(others[at] == ids)
        return same, at[same]

    def count(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                s = _scores(batch, r, bound)
                ids, others = V.matrix(batch, "q_ids", r, np.int64), V.matrix(batch, "e_ids", r, np.int64)
                low, high, need = (V.matrix(batch, f"q_{c}", r, np.int64) for c in ("low", "high", "need"))
                width = (high - low) // BINS + 1
                # bins count from the top; those that lie outside the interval go to one more bin, which is not kept
                bin_ = (high[:, None] - s) // width[:, None]
                bin_[(bin_ < 0) | (s < low[:, None])] = BINS
                bin_[own(ids, others)] = BINS
                h = np.bincount((bin_ + np.arange(len(ids))[:, None] * (BINS + 1)).ravel(), minlength=len(ids) * (BINS + 1)).reshape(len(ids), -1)[:, :BINS]
                row, b = np.nonzero((h > 0) & (np.cumsum(h, axis=1) - h < need[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(b, pa.int64()), pa.array(h[row, b], pa.int64())], ["id", "bin", "n"])

    passes = math.ceil(math.log(2 * min(bound, 2.0**62) + 4, BINS)) + 1 if n_queries else 0
    for _ in range(passes):
        counts = paired(state).mapInArrow(count, "id long, bin long, n long").groupBy("id", "bin").agg(F.sum("n").alias("n"))
        so_far = F.sum("n").over(Window.partitionBy("id").orderBy("bin"))
        found = counts.withColumn("upto", so_far).join(state.select("id", "need"), "id").where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
        found = found.select("id", "bin", (F.col("upto") - F.col("n")).alias("above"))
        width = F.expr(f"(high - low) div {BINS} + 1")
        top = F.col("high") - F.col("bin") * width
        # without a bin, there are fewer scores than wanted: all of them are
        state = cut(
            state.join(found, "id", "left").select(
                "id", "dim", "block", "vec",
                F.when(F.col("bin").isNull(), F.col("low")).otherwise(F.greatest("low", top - width + 1)).alias("low"),
                F.when(F.col("bin").isNull(), F.col("low")).otherwise(top).alias("high"),
                (F.col("need") - F.coalesce("above", F.lit(0))).alias("need"),
            )
        )
        if not state.where("low < high").limit(1).count():
            break

    def keep(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                s = _scores(batch, r, bound)
                ids, others = V.matrix(batch, "q_ids", r, np.int64), V.matrix(batch, "e_ids", r, np.int64)
                low, need = (V.matrix(batch, f"q_{c}", r, np.int64) for c in ("low", "need"))
                want, tie = s > low[:, None], s == low[:, None]
                mine = own(ids, others)
                want[mine] = tie[mine] = False
                want |= tie & (np.cumsum(tie, axis=1) <= need[:, None])  # ids ascend within a block
                row, c = np.nonzero(want)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(others[c]), pa.array(s[row, c])], ["query_id", "id", "score"])

    kept = paired(state).mapInArrow(keep, "query_id long, id long, score long")
    return V.best(kept, k).select(F.col("query_id").cast(kind), F.col("rank").cast("int"), F.col("id").cast(kind).alias(id_col), "score")
