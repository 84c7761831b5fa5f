"""Connected components of a graph given as a table of links, by alternating large and small stars.

Every round links each vertex' larger neighbours to its smallest one, then its smaller neighbours; the graph shrinks to
stars around each component's smallest vertex in about as many rounds as the logarithm of its diameter. Links stay in
tables; a round is cut off from its lineage in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaline.llm.shared import cut, discard, release, tasks

#: Links that a task takes at least, once there are more than the cores can share.
LINKS = 1_000_000


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out evenly, so that a join shuffles both its sides and adaptive execution can split a hot key."""
    n = tasks(rows.sparkSession)
    return rows.coalesce(n).repartition(n)


def _star(links: DataFrame, parts: int) -> DataFrame:
    """Of (u, v): every v beside the least of u and its v, in at most ``parts`` tasks."""
    least = links.groupBy("u").agg(F.min("v").alias("least")).coalesce(parts).repartition(parts)
    return links.join(least, "u").select("u", "v", F.least("u", "least").alias("least")).coalesce(parts)


def components(links: DataFrame) -> DataFrame:
    """``v`` and ``root`` (its component's smallest vertex) of every vertex in ``links`` (a, b)."""
    few = tasks(links.sparkSession)
    now = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), few)
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, few).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        small = _star(large, few)
        small = small.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(small.select("u", F.col("least").alias("v")))
        before, now = now, cut(small.distinct(), few)
        discard(before)
        release(links.sparkSession)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen, few = state, max(tasks(links.sparkSession), state[0] // LINKS)
    roots = now.select(F.col("v").alias("v")).distinct()
    return now.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(roots.select("v", F.col("v").alias("root")))
