"""Row groups that only a Bloom filter lets a reader skip."""

from __future__ import annotations

from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quotaline.sinks.clustered import with_blooms


def rows_read(df) -> int:
    """Rows that the scan gave out."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value()


def test_point_reads_skip_row_groups_within_their_bounds(spark, tmp_path):
    """A thousand reps, the same few in each of many row groups: every group's bounds hold nearly all reps."""
    group = F.col("id") / 1000
    rep = F.pmod(F.xxhash64(F.floor(group), F.pmod("id", F.lit(40))), F.lit(1000))
    rows = spark.range(0, 200_000, 1, 1).select(F.format_string("R%04d", rep).alias("rep_id"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    for name, writer in (("plain", rows.write), ("bloom", with_blooms(rows))):
        # without dictionaries, which would tell a reader as much while a group's values fit into one
        writer.option("parquet.block.size", 256 << 10).option("parquet.enable.dictionary", "false").option("parquet.page.row.count.limit", 1000).parquet(f"{tmp_path}/{name}")
    (file,) = Path(tmp_path / "bloom").glob("*.parquet")
    meta = pq.read_metadata(file)
    assert meta.num_row_groups > 20
    wanted = rows.first().rep_id
    column = next(k for k in range(meta.num_columns) if meta.schema.column(k).name == "rep_id")
    inside = [s.min <= wanted <= s.max for s in (meta.row_group(k).column(column).statistics for k in range(meta.num_row_groups))]
    assert sum(inside) > 0.9 * meta.num_row_groups
    read = {name: spark.read.parquet(f"{tmp_path}/{name}").where(F.col("rep_id") == wanted) for name in ("plain", "bloom")}
    assert read["plain"].count() == read["bloom"].count() > 0
    counts = {name: rows_read(df) for name, df in read.items()}
    assert counts["bloom"] < 0.8 * counts["plain"]
