"""Session settings the transforms are written for."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession

SETTINGS = {
    # Dates are truncated and formatted as calendar days, so the zone must not move them.
    "spark.sql.session.timeZone": "UTC",
    # Join strategies are left to the planner: it broadcasts only sides under its own size threshold, and
    # otherwise shuffles, splitting partitions that one hot key fills.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}

INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: Bytes of input for each partition that a shuffle starts with, and their largest number.
PARTITION_BYTES = 256 << 20
MOST = 50_000
READ = "spark.sql.files.maxPartitionBytes"
#: Spark's own setting for removing the shuffle files of an action when it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a file that a task sorts as it reads them: rows in memory take about ten times as many.
SORTED_BYTES = 32 << 20

#: Bytes of rows that are written at a time, and the most times that a table's writing takes.
PASS_BYTES = 128 << 20
MOST_PASSES = 8
#: A size beyond this is Spark's word for one that it does not know, as of rows that lie in no file.
UNKNOWN = 1 << 60


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Add the settings to a session builder."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def initial_partitions(input_bytes: int, at_least: int = 200) -> int:
    """How many partitions a shuffle of so many bytes should start with.

    Adaptive execution merges partitions that turn out small but never splits even ones, so the number has to come
    from the input: 100 TB start with ``MOST`` partitions of 2 GB rather than with 200 of 500 GB.
    """
    return max(at_least, min(MOST, -(-input_bytes // PARTITION_BYTES)))


def _bytes(spark: SparkSession, value: str) -> int:
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(value)


def is_broadcast(side: DataFrame) -> bool:
    """Whether the planner broadcasts this side of a join, by its measured size and the session's threshold."""
    spark = side.sparkSession
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    size = side._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return not threshold.startswith("-") and size <= _bytes(spark, threshold)


def input_bytes(rows: DataFrame) -> int:
    """Bytes of what a frame reads."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(leaves.apply(k).stats().sizeInBytes() for k in range(leaves.size()))


def passes(read: int) -> int:
    """In how many turns so many bytes are written, so that a part of their shuffles is on disk at a time."""
    return max(1, min(MOST_PASSES, -(-read // PASS_BYTES))) if read < UNKNOWN else 1


def in_turn(rows: Mapping, turns: int) -> list[list]:
    """The keys of some row counts, in their order, in so many groups of about as many rows (fewer, if a key has more)."""
    groups, total, held = {}, max(1, sum(rows.values())), 0
    for key, n in rows.items():
        groups.setdefault(held * turns // total, []).append(key)
        held += n
    return list(groups.values())


def in_ranges(rows: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Rows dealt to ranges of an order, which are small enough for a task to sort in memory.

    The session's number of partitions, of which adaptive execution merges small ones, unless the input asks for more.
    """
    spark = rows.sparkSession
    wanted = min(MOST, -(-input_bytes(rows) // SORTED_BYTES))
    held = int(spark.conf.get(INITIAL, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(wanted, *order) if wanted > held else rows.repartitionByRange(*order)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting with a value for a while."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def freed_shuffles(spark: SparkSession):
    """Remove the shuffle files of every action when it ends, not when the driver happens to collect its garbage.

    A job of many writes then holds the shuffles of those that run, not of all. An action on the same frame again
    computes what it needs once more.
    """
    return _setting(spark, FREED, "true")


def small_reads(spark: SparkSession):
    """Read files in parts of ``SORTED_BYTES`` at most, which a task can sort in memory."""
    return _setting(spark, READ, str(min(_bytes(spark, spark.conf.get(READ)), SORTED_BYTES)))


@contextmanager
def sized_for(spark: SparkSession, input_bytes: int) -> Iterator[int]:
    """Start shuffles with as many partitions as the input asks for, and at least the session's own number."""
    wanted = initial_partitions(input_bytes, int(spark.conf.get("spark.sql.shuffle.partitions")))
    with _setting(spark, INITIAL, str(wanted)):
        yield wanted
