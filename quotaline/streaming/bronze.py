"""Incremental ingest: every file of a landing folder reaches its bronze table exactly once.

Footers are read once a file: what the files before them hold, and which they were, is kept beside the stream's
checkpoint (a mark of 16 characters a file). New files are checked before a batch begins: one that is no Parquet file, or
holds a column in a type that the table's does not take, stops the ingest, or with ``rejected`` is set aside there with
its reason while all others arrive.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quotaline.sinks import batchfolders, folders
from quotaline.sinks.batchfolders import BATCH
from quotaline.sinks.clustered import clustered, writer
from quotaline.sources.schemas import ENTITIES

INGESTED_AT, SOURCE_FILE = "_ingested_at", "_source_file"
#: A backlog is read in batches of so many bytes unless the caller says otherwise.
BATCH_BYTES = 256 << 30
#: Files count however old they are: the source's own limit, a week, would skip late ones without a word.
ANY_AGE = "36500d"


def with_audit_columns(files: DataFrame) -> DataFrame:
    """Add when and from which file each row was read. For DataFrames that read files directly."""
    return files.withColumns(
        {INGESTED_AT: F.current_timestamp(), SOURCE_FILE: F.col("_metadata.file_path")}
    )


REJECTED_FILES = T.StructType([T.StructField(n, T.StringType()) for n in ("entity", "file", "reason")] + [T.StructField("rejected_at", T.TimestampType())])
#: What a column takes besides its own type: types that the Parquet reader widens without loss.
WIDENED = {"bigint": ("tinyint", "smallint", "int"), "double": ("float", "tinyint", "smallint", "int"), "int": ("tinyint", "smallint")}


def _clash(schema: T.StructType, known: T.StructType) -> str | None:
    """Why a file's columns do not fit those known, or None."""
    types = {f.name.lower(): f.dataType.simpleString() for f in known.fields}
    for f in schema.fields:
        kind, wanted = f.dataType.simpleString(), types.get(f.name.lower(), f.dataType.simpleString())
        if kind != wanted and kind not in WIDENED.get(wanted, ()):
            return f"column {f.name} is {kind}, not {wanted}"
    return None


def _merged(known: T.StructType, schema: T.StructType) -> T.StructType:
    """The known columns, and after them those that files hold besides."""
    names = {n.lower() for n in known.names}
    return T.StructType([*known.fields, *[f for f in schema.fields if f.name.lower() not in names]])


def _root_cause(error: Exception) -> str:
    """What the reader said last, in a line."""
    message = str(error)
    if isinstance(error, Py4JJavaError):
        cause = error.java_exception
        while cause.getCause() is not None:
            cause = cause.getCause()
        message = cause.toString()
    return message.splitlines()[0][:300]


def checked(spark: SparkSession, folder: str, files: list[str], known: T.StructType, reject: Callable[[str, str], None]) -> T.StructType:
    """The known columns and those of the files that fit; ``reject`` gets each file that does not, and why.

    All footers are read together, by Spark; only if that fails, or what it finds does not fit, by halves.
    """
    if not files:
        return known
    try:
        schema = spark.read.option("mergeSchema", "true").parquet(*[f"{folder}/{f}" for f in files]).schema
        reason = _clash(schema, known)
    except Exception as e:  # whatever the reader makes of a file that it cannot read
        reason = _root_cause(e)
    if reason is None:
        return _merged(known, schema)
    if len(files) == 1:
        reject(files[0], reason)
        return known
    half = len(files) // 2
    return checked(spark, folder, files[half:], checked(spark, folder, files[:half], known, reject), reject)


def read_rejected(spark: SparkSession, rejected: str) -> DataFrame:
    """The files that were set aside: entity, name, reason and time."""
    return spark.read.schema(REJECTED_FILES).parquet(f"{rejected}/files") if folders.exists(spark, f"{rejected}/files") else spark.createDataFrame([], REJECTED_FILES)


def landed_schema(spark: SparkSession, entity: str, folder: str, checkpoint: str | None = None, rejected: str | None = None) -> T.StructType:
    """The entity's declared columns, and after them those that files in the folder have, or had, besides.

    With ``checkpoint``, only the footers of files that came since the last call are read.
    """
    place = None if checkpoint is None else f"{checkpoint}/footers"
    state = (folders.published(spark, place) if place else None) or {}
    known = T.StructType.fromJson(state["schema"]) if state else ENTITIES[entity].schema
    seen, present = set(state.get("seen", ())), folders.marks(spark, folder)
    gone: list[tuple] = []

    def reject(name: str, reason: str) -> None:
        if rejected is None:
            raise ValueError(f"{folder}/{name}: {reason}")
        folders.ensure(spark, f"{rejected}/{entity}")
        folders.move(spark, f"{folder}/{name}", f"{rejected}/{entity}/{name}")
        gone.append((entity, name, reason, datetime.now(timezone.utc).replace(tzinfo=None)))

    new = sorted(n for n, mark in present.items() if mark not in seen)
    schema = checked(spark, folder, new, known, reject)
    if gone:
        spark.createDataFrame(gone, REJECTED_FILES).coalesce(1).write.mode("append").parquet(f"{rejected}/files")
    if place and new:
        left = set(present) - {name for _, name, _, _ in gone}
        folders.publish(spark, place, {"tables": {}, "schema": schema.jsonValue(), "seen": sorted(present[n] for n in left)}, after=state.get("number"))
        folders.sweep(spark, place)
    return schema


def read_landing_stream(
    spark: SparkSession,
    entity: str,
    folder: str,
    max_bytes_per_trigger: int = BATCH_BYTES,
    archive: str | None = None,
    checkpoint: str | None = None,
    rejected: str | None = None,
) -> DataFrame:
    """The landing folder as a stream of its parquet files, with all their columns.

    The stream remembers the path of every file it has read. ``archive`` moves files there once they are in, which
    keeps listings to what is new.
    """
    folders.ensure(spark, folder)
    reader = spark.readStream.schema(landed_schema(spark, entity, folder, checkpoint, rejected)).option("maxFileAge", ANY_AGE)
    reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    if archive is not None:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return with_audit_columns(reader.parquet(folder))


def start_ingest(
    spark: SparkSession,
    entity: str,
    folder: str,
    bronze: str,
    checkpoint: str,
    max_bytes_per_trigger: int = BATCH_BYTES,
    archive: str | None = None,
    rejected: str | None = None,
) -> StreamingQuery:
    """Start appending the files not seen before to the bronze table; the query ends when they are all in.

    The checkpoint records which files each micro-batch holds, and a micro-batch writes one folder named by its
    number. A batch run again after a failure holds the same files and replaces its own folder, so no row is lost or
    doubled. ``max_bytes_per_trigger`` bounds a batch, and with it the work to repeat, when a large backlog is read.
    Rows are laid out by the entity's layout columns within a batch.
    """
    layout = ENTITIES[entity].bronze_layout

    def write_batch(rows: DataFrame, number: int) -> None:
        writer(clustered(rows, layout)).mode("overwrite").parquet(f"{bronze}/{BATCH}={number}")

    stream = read_landing_stream(spark, entity, folder, max_bytes_per_trigger, archive, checkpoint, rejected)
    return (
        stream.writeStream.queryName(f"ingest_{entity}")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write_batch)
        .start()
    )


def ingest(
    spark: SparkSession,
    entity: str,
    folder: str,
    bronze: str,
    checkpoint: str,
    max_bytes_per_trigger: int = BATCH_BYTES,
    archive: str | None = None,
    rejected: str | None = None,
) -> None:
    """Ingest one entity and wait until it is done."""
    start_ingest(spark, entity, folder, bronze, checkpoint, max_bytes_per_trigger, archive, rejected).awaitTermination()


def batches(spark: SparkSession, table: str) -> list[int]:
    """The numbers of the batches that a table holds."""
    return batchfolders.numbers(spark, table)


def read_bronze(spark: SparkSession, entity: str, bronze: str, only: list[int] | None = None) -> DataFrame:
    """The ingested rows: declared columns, undeclared ones and the audit columns. No rows if none were ingested.

    ``only`` reads some batches, and adds their numbers as a column.
    """
    declared = ENTITIES[entity].schema
    audit = T.StructType([T.StructField(INGESTED_AT, T.TimestampType()), T.StructField(SOURCE_FILE, T.StringType())])
    rows = batchfolders.read(spark, bronze, only)
    if rows is None:
        return spark.createDataFrame([], T.StructType([*declared.fields, *audit.fields]))
    others = [c for c in rows.columns if c not in {*declared.names, *audit.names, BATCH}]
    return rows.select(*declared.names, *others, *audit.names, *([] if only is None else [BATCH]))
