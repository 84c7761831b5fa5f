"""Vectors in blocks: rows of a few thousand vectors as one matrix, and pairs of such blocks.

Only a stated set of queries meets all rows, block by block; no pair of rows leaves a task unless it is wanted.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str, vec_col: str, component) -> DataFrame:
    """``id``, ``vec``, ``dim`` of the vectors that take part, ``component`` applied to each number as a double.

    Null vectors, empty ones and those with null or non-finite numbers take no part, nor do rows without an id. Rows
    that repeat an id count once, with the smallest of their vectors.
    """
    v = vectors.select(vectors[id_col].alias("id"), vectors[vec_col].cast("array<double>").alias("vec")).where(F.col("id").isNotNull())
    bad: Column = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where((F.size("vec") > 0) & ~F.coalesce(bad, F.lit(True)))
    return v.groupBy("id").agg(F.min(F.transform("vec", component)).alias("vec")).withColumn("dim", F.size("vec"))


def blocks(rows: DataFrame, *extra: str) -> DataFrame:
    """One row per (dim, block): ``n``, ``ids`` and ``vecs`` as lists in order of id, and the ``extra`` columns' lists."""
    packed = F.sort_array(F.collect_list(F.struct("id", "vec", *extra)))
    out = rows.groupBy("dim", "block").agg(packed.alias("rows"))
    return out.select("dim", "block", F.col("rows.id").alias("ids"), F.flatten("rows.vec").alias("vecs"), *(F.col(f"rows.{x}").alias(x) for x in extra))


def numbered(rows: DataFrame, n_blocks: int) -> DataFrame:
    """Rows dealt evenly to blocks by their id."""
    return rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))


def pairs(queries: DataFrame, entries: DataFrame, n_query_blocks: int, n_entry_blocks: int) -> DataFrame:
    """Every query block beside every entry block of its dimension, a row each; columns are prefixed q_ and e_."""
    q = queries.select("dim", *(F.col(c).alias(f"q_{c}") for c in queries.columns if c != "dim"))
    e = entries.select("dim", *(F.col(c).alias(f"e_{c}") for c in entries.columns if c != "dim"))
    q = q.withColumn("e_block", F.explode(F.sequence(F.lit(0), F.lit(n_entry_blocks - 1))))
    e = e.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1))))
    return q.join(e, ["dim", "q_block", "e_block"])


def matrix(batch, name: str, row: int, dtype) -> np.ndarray:
    """A list column's value in one row as an array."""
    return batch.column(batch.schema.get_field_index(name))[row].values.to_numpy(zero_copy_only=False).astype(dtype, copy=False)


def best(rows: DataFrame, k: int) -> DataFrame:
    """Of (query_id, id, score): each query's ``k`` best by score, ties to the smaller id, with rank from 1."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
