"""Tables that grow by numbered batches, and whose small batches are merged level by level.

A new batch is a folder ``ingest_batch=N``; a folder of ``fanout ** k`` batches or more is of level k. ``compact`` merges
the newest folders up to a level into one of the next as soon as they hold enough batches for it, so that n batches lie
in about ``fanout * log(n)`` folders, a row is rewritten about ``log(n)`` times, and a backlog is merged at once.
Merged folders keep each row's batch number as a column, and a published state names them with the batches they hold; a
batch folder that a merged one holds is not read any more.

A crash at any step leaves every row readable once: a merged folder that no state names is not read, and what a merge
made needless is removed only when the next compaction begins, so that readers of the state before keep their files. New batches may be written meanwhile: numbers only grow, and only the newest may be
written again, which ``compact`` leaves alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaline.sinks import folders
from quotaline.sinks.clustered import writer

BATCH = "ingest_batch"
FANOUT = 8


def _state(spark: SparkSession, table: str) -> dict:
    return folders.published(spark, table) or {"tables": {"batches": {"merged": []}}, "gone": []}


def _merged(state: dict) -> list[dict]:
    return state["tables"]["batches"]["merged"]


def _alone(spark: SparkSession, table: str, state: dict) -> list[int]:
    """Batches in folders of their own."""
    held = {n for m in _merged(state) for n in range(m["first"], m["last"] + 1)}
    return sorted({int(n.split("=")[1]) for n in folders.names(spark, table) if n.startswith(f"{BATCH}=")} - held)


def numbers(spark: SparkSession, table: str) -> list[int]:
    """The numbers of the batches that a table holds."""
    state = _state(spark, table)
    return sorted({n for m in _merged(state) for n in range(m["first"], m["last"] + 1)} | set(_alone(spark, table, state)))


def read(spark: SparkSession, table: str, only: list[int] | None = None) -> DataFrame | None:
    """The rows of all batches, or of some, with the number of each row's batch; None without batches.

    Columns that only some batches have are null elsewhere.
    """
    state = _state(spark, table)
    wanted = None if only is None else set(only)
    alone = [n for n in _alone(spark, table, state) if wanted is None or n in wanted]
    merged = [m for m in _merged(state) if wanted is None or wanted & set(range(m["first"], m["last"] + 1))]
    reader = spark.read.option("mergeSchema", "true")
    parts = []
    if alone:
        parts.append(reader.option("basePath", table).parquet(*[f"{table}/{BATCH}={n}" for n in alone]))
    if merged:
        rows = reader.parquet(*[f"{table}/{m['path']}" for m in merged])
        parts.append(rows if wanted is None else rows.where(F.col(BATCH).isin(sorted(wanted))))
    if not parts:
        return None
    parts = [p.withColumn(BATCH, F.col(BATCH).cast("int")) for p in parts]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def _level(batches: int, fanout: int) -> int:
    level = 0
    while batches >= fanout:
        batches, level = batches // fanout, level + 1
    return level


def compact(spark: SparkSession, table: str, layout: Callable[[DataFrame], DataFrame] = lambda rows: rows, fanout: int = FANOUT) -> int:
    """Merge the newest folders while they hold enough batches for a higher level; returns how many merges were made.

    ``layout`` orders the rows of a merged folder. Run by one job at a time: of two that publish, one fails. What
    compactions before this one made needless is removed first.
    """
    state, done = _state(spark, table), 0
    if "number" in state:
        for n in state["gone"]:
            folders.remove(spark, f"{table}/{BATCH}={n}")
        folders.sweep(spark, table, keep=1)
    gone: list[int] = []
    while True:
        state = _state(spark, table)
        alone = _alone(spark, table, state)
        units = [(m["first"], m["last"], m["path"]) for m in _merged(state)] + [(n, n, None) for n in alone[:-1]]
        units.sort(key=lambda u: u[0])
        levels = [_level(last - first + 1, fanout) for first, last, _ in units]
        some = []
        for level in range(max(levels, default=0) + 1 + len(units) // fanout, -1, -1):
            begin = max((k + 1 for k, own in enumerate(levels) if own > level), default=0)
            tail = units[begin:]
            if len(tail) > 1 and sum(last - first + 1 for first, last, _ in tail) >= fanout ** (level + 1):
                some = tail
                break
        if not some:
            return done
        first, last = some[0][0], some[-1][1]
        path = f"version-{uuid.uuid4().hex}/merged"
        inside = [n for n in numbers(spark, table) if first <= n <= last]
        writer(layout(read(spark, table, inside))).parquet(f"{table}/{path}")
        kept = [m for m in _merged(state) if m["path"] not in {p for *_, p in some}]
        gone += [n for n in alone if first <= n <= last]
        merged = sorted([*kept, {"path": path, "first": first, "last": last}], key=lambda m: m["first"])
        folders.publish(spark, table, {"tables": {"batches": {"merged": merged}}, "gone": gone}, after=state.get("number"))
        done += 1
