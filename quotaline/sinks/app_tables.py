"""Append-only application tables: rep feedback and manager overrides.

An append is a folder of its own below the table's, complete before it gets its name: readers see all of its rows or
none, however many files it has. With a key, an append is stored once however often it is tried: the first to claim the
key wins, and whoever finds it claimed finishes what the winner left undone.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotaline.sinks import folders
from quotaline.sinks.clustered import with_blooms
from quotaline.sources import schemas as S

TABLES = {"sales_feedback": S.SALES_FEEDBACK, "manager_overrides": S.MANAGER_OVERRIDES}


def ensure_namespace(spark: SparkSession, namespace: str, root: str | None = None) -> None:
    """Create a schema if it is missing, optionally below a folder."""
    location = f" LOCATION '{root}'" if root else ""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {namespace}{location}")


def ensure_app_tables(spark: SparkSession, namespace: str, root: str | None = None) -> None:
    """Create the two application tables if they are missing. Below ``root``, dropping them keeps their files."""
    for name, schema in TABLES.items():
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
        location = f" LOCATION '{root}/{name}'" if root else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {namespace}.{name} ({columns}) USING parquet OPTIONS (recursiveFileLookup 'true'){location}")


def _location(spark: SparkSession, table: str) -> str:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").collect()
    return rows[0]["data_type"].rstrip("/")


def read(spark: SparkSession, name: str, location: str) -> DataFrame:
    """The rows of an application table's folder."""
    return spark.read.schema(TABLES[name]).option("recursiveFileLookup", "true").parquet(location)


def _finish(spark: SparkSession, location: str, mark: str) -> None:
    """Let readers see a complete folder, unless they do already."""
    if folders.exists(spark, f"{location}/_new-{mark}"):
        folders.move(spark, f"{location}/_new-{mark}", f"{location}/append-{mark}")


def _add(rows: DataFrame, table: str, location: str, key: str | None = None) -> bool:
    """Write rows beside the table, then move the complete folder in; False if ``key`` was stored already.

    Any number of writers can append at once: they share no folder but the table's, and only rename into that.
    """
    spark, mark = rows.sparkSession, uuid.uuid4().hex
    claimed = None if key is None else f"{location}/_commits/{hashlib.sha256(key.encode()).hexdigest()}"
    won = claimed is None or not folders.exists(spark, claimed)
    if won:
        with_blooms(rows).parquet(f"{location}/_new-{mark}")
        if claimed is not None:
            try:
                folders.write_once(spark, claimed, mark)
            except FileExistsError:  # another writer of the same key was faster
                folders.remove(spark, f"{location}/_new-{mark}")
                won = False
    _finish(spark, location, mark if won else folders.read(spark, claimed))
    spark.catalog.refreshTable(table)
    return won


def _append(rows: DataFrame, table: str, schema: T.StructType, stamp: str, key: str | None) -> bool:
    """Append in schema order, filling in the id, and the time where the row brings none."""
    given = {f.name: F.col(f.name) if f.name in rows.columns else F.lit(None) for f in schema.fields}
    given["id"] = F.expr("uuid()")
    given[stamp] = F.coalesce(given[stamp].cast("timestamp"), F.current_timestamp())
    ordered = [given[f.name].cast(f.dataType).alias(f.name) for f in schema.fields]
    location = _location(rows.sparkSession, table)
    _recover(rows.sparkSession, location)
    return _add(rows.select(*ordered), table, location, key)


def decoded(adjustments: Column) -> Column:
    """Adjustments from JSON text. Text that is malformed, or holds an amount that is no number, is an error."""
    return F.from_json(adjustments, S.ADJUSTMENTS, {"mode": "FAILFAST"})


def valid(adjustments: Column) -> Column:
    """The adjustments, or an error: every one needs a deal, both amounts and an adjusted amount not below zero, and
    a submission adjusts a deal once."""

    def lacks(a: Column) -> Column:
        return a["deal_id"].isNull() | a["original_forecast"].isNull() | a["adjusted_forecast"].isNull()

    deals = F.transform(adjustments, lambda a: a["deal_id"])
    return (
        F.when(F.exists(adjustments, lacks), F.raise_error("an adjustment lacks its deal or an amount"))
        .when(F.exists(adjustments, lambda a: a["adjusted_forecast"] < 0), F.raise_error("an adjusted forecast is below zero"))
        .when(F.size(F.array_distinct(deals)) < F.size(deals), F.raise_error("a deal is adjusted twice in a submission"))
        .otherwise(adjustments)
    )


def append_feedback(rows: DataFrame, namespace: str, key: str | None = None) -> bool:
    """Append submissions; adjustments may come as an array or as JSON text. Invalid ones fail the whole append.

    ``key`` names the append: tried again with the same key, nothing more is stored, and False is returned.
    """
    if "adjustments" in rows.columns:
        if isinstance(rows.schema["adjustments"].dataType, T.StringType):
            rows = rows.withColumn("adjustments", decoded(F.col("adjustments")))
        rows = rows.withColumn("adjustments", valid(F.col("adjustments")))
    return _append(rows, f"{namespace}.sales_feedback", S.SALES_FEEDBACK, "submitted_at", key)


def append_override(rows: DataFrame, namespace: str, key: str | None = None) -> bool:
    """Append approved overrides, once for each ``key``."""
    return _append(rows, f"{namespace}.manager_overrides", S.MANAGER_OVERRIDES, "approved_at", key)


_PLAN = "_compacting"


def _recover(spark: SparkSession, location: str) -> None:
    """Finish a compaction that ended half way: its rows in, those that it replaces out."""
    if not folders.exists(spark, f"{location}/{_PLAN}"):
        return
    plan = json.loads(folders.read(spark, f"{location}/{_PLAN}"))
    _finish(spark, location, plan["new"])
    for name in plan["old"]:
        folders.remove(spark, f"{location}/{name}")
    folders.remove(spark, f"{location}/{_PLAN}")


def compact(spark: SparkSession, namespace: str, name: str) -> int:
    """Put a table's present appends together; returns how many went. Appends may go on meanwhile.

    Run by one job at a time. A reader that lists the folder while the old appends go sees rows twice, told by their
    id. A compaction that ends half way is finished by the next one or the next append.
    """
    table = f"{namespace}.{name}"
    location = _location(spark, table)
    _recover(spark, location)
    present = folders.names(spark, location)
    if len(present) < 2:
        return 0
    mark = uuid.uuid4().hex
    rows = spark.read.schema(TABLES[name]).option("recursiveFileLookup", "true").parquet(*[f"{location}/{n}" for n in present])
    with_blooms(rows.repartition(max(1, folders.size(spark, location) >> 28))).parquet(f"{location}/_new-{mark}")
    folders.write_once(spark, f"{location}/{_PLAN}", json.dumps({"new": mark, "old": present}))
    _recover(spark, location)
    spark.catalog.refreshTable(table)
    return len(present)


def adjustments_as_json(feedback: DataFrame) -> DataFrame:
    """Submissions with the adjustments as JSON text, for stores without arrays."""
    return feedback.withColumn("adjustments", F.to_json("adjustments"))
