"""Tables laid out by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from quotaline.sinks import folders

#: How tables are compressed: smaller files than the default's, for about the same time.
CODEC = "zstd"
#: Rows drawn to find the quantiles of keys: they decide where rows lie, never which.
SAMPLE = 20_000
#: Bytes of a row group of rows set aside: a reader skips those without the days it wants.
ASIDE_BYTES = 8 << 20


#: Columns that are looked up by value, in whatever order a table's rows lie.
POINT_KEYS = ("rep_id", "deal_id", "invoice_id")


def writer(df: DataFrame) -> DataFrameWriter:
    """A writer of compressed files."""
    return df.write.option("compression", CODEC)


def with_blooms(df: DataFrame) -> DataFrameWriter:
    """A writer that adds a Bloom filter for each point key to every row group: a reader skips those without the value.

    Filters take the size that the row group's number of values asks for.
    """
    written = writer(df)
    for column in POINT_KEYS:
        if column in df.columns:
            written = written.option(f"parquet.bloom.filter.enabled#{column}", "true")
    return written.option("parquet.bloom.filter.adaptive.enabled", "true")


def set_aside(df: DataFrame, path: str, key: str) -> DataFrame:
    """Rows that are costly to make, in files of their own, by ``key`` within each: reads of a part of its values skip the rest.

    What was shuffled to make them need not be on disk with what they are shuffled to next.
    """
    writer(df.sortWithinPartitions(key)).option("parquet.block.size", str(ASIDE_BYTES)).parquet(path)
    return df.sparkSession.read.parquet(path)


def clustered(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bring rows with equal leading keys together, sorted by all keys.

    A file then holds few values of the leading key, so a filter on it skips whole files. A rebalance, not a range
    partitioning: it needs no sampling pass over the input, adaptive execution picks the number of files from their
    size, and it splits a value that holds too many rows (or copies of one row) instead of giving it one task.
    """
    return df.hint("rebalance", keys[0]).sortWithinPartitions(*keys)


def ranged(df: DataFrame, keys: Sequence[str], row_key: str) -> DataFrame:
    """Order rows by ``keys`` across files, so that a filter on a prefix of the keys skips files.

    The row's own key ends the order: a hot combination of keys spans as many files as it needs. Rows that lie in
    ranges of that order already are sorted where they are.
    """
    return df.orderBy(*keys, *([row_key] if row_key not in keys else []))


def by_month(df: DataFrame, month: str, keys: Sequence[str]) -> DataFrame:
    """Bring each month together, its files sorted by ``keys``.

    A rebalance: nothing is sampled, so what comes before is not computed twice, and a month with many rows is split.
    """
    return df.hint("rebalance", month).sortWithinPartitions(month, *keys)


def write_clustered(df: DataFrame, path: str, keys: Sequence[str], row_key: str | None = None) -> None:
    """Replace a parquet table, laid out by ``keys`` (with ``row_key``: in their order across files).

    The new table is written beside the old one and takes its place when it is complete.
    """
    staged = folders.beside(path)
    rows = clustered(df, keys) if row_key is None else ranged(df, keys, row_key)
    writer(rows).parquet(staged)
    folders.swap_in(df.sparkSession, staged, path)


def _rank(key: str, bounds: list) -> Column:
    """How many of the bounds a key has reached: its quantile. Nulls come first."""
    if not bounds:
        return F.lit(0)
    reached = F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(key))
    return F.when(F.col(key).isNull(), 0).otherwise(F.size(reached))


def _interleaved(ranks: list[Column], bits: int) -> Column:
    """The ranks' bits in turn, the first key's highest bit first: near in the result is near in every key."""
    out = F.lit(0)
    for bit in range(bits):
        for k, rank in enumerate(ranks):
            place = bit * len(ranks) + (len(ranks) - 1 - k)
            out = out.bitwiseOR(F.shiftleft(F.shiftright(rank, bit).bitwiseAND(F.lit(1)), place))
    return out


def interleaved(df: DataFrame, keys: Sequence[str], row_key: str, files: int, bits: int = 5) -> DataFrame:
    """Rows in about ``files`` partitions of like size along a Z-order curve over all ``keys``.

    Each key counts by its quantile among ``2**bits``, so an uneven key is spread as well as an even one, and a filter on
    any one of d keys opens about the d-th root of the files to the power d - 1. Quantiles and the sizes of cells come
    from ``SAMPLE`` rows drawn in one pass over the keys; a cell that fills several files is dealt to them by
    ``row_key``. Nothing else is sampled: rows go to their partition by its number.
    """
    spark = df.sparkSession
    drawn = df.select(*keys).orderBy(F.rand(17)).limit(SAMPLE)
    n = 1 << bits
    held = drawn.agg(*[F.sort_array(F.collect_list(k)).alias(k) for k in keys]).first()
    bounds = {k: sorted({held[k][len(held[k]) * q // n] for q in range(1, n)}) if held[k] else [] for k in keys}
    place = _interleaved([_rank(k, bounds[k]) for k in keys], bits)
    cells = sorted((r["cell"], r["count"]) for r in drawn.select(place.alias("cell")).groupBy("cell").count().collect())
    total = max(1, sum(c for _, c in cells))
    # blocks of cells, about as many as files: a block begins with a file and gets as many as its share asks for
    shift = max(0, bits * len(keys) - (files.bit_length() - 1))
    blocks: dict[int, int] = {}
    for cell, count in cells:
        blocks[cell >> shift] = blocks.get(cell >> shift, 0) + count
    begin, places, held_of, used = {}, [], {}, 0
    for block, count in blocks.items():
        begin[block] = used
        used += max(1, round(count / total * files))
    for cell, count in cells:
        block = cell >> shift
        width = (max(1, round(blocks[block] / total * files)) - 1e-9) / blocks[block]
        before = held_of.get(block, 0)
        places.append((cell, begin[block] + before * width, count * width))
        held_of[block] = before + count
    used = max(used, 1)
    known = F.broadcast(spark.createDataFrame(places, "cell int, before double, share double"))  # at most a row for each cell
    spot = F.pmod(F.xxhash64(row_key), F.lit(1 << 20)) / (1 << 20)
    inside = F.coalesce(F.col("before") + F.col("share") * spot, F.col("cell") * F.lit(used / n ** len(keys)))  # a cell that was not drawn
    file = F.least(F.floor(inside), F.lit(used - 1)).cast("int")
    rows = df.withColumn("cell", place).join(known, "cell", "left").withColumn("file", file)
    return rows.repartitionById(used, "file").sortWithinPartitions("cell", *keys, row_key).select(*df.columns)


def write_interleaved(df: DataFrame, path: str, keys: Sequence[str], row_key: str, files: int) -> None:
    """Replace a parquet table, laid out so that a filter on any of the keys skips files."""
    staged = folders.beside(path)
    writer(interleaved(df, keys, row_key, files)).parquet(staged)
    folders.swap_in(df.sparkSession, staged, path)
