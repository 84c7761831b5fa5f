"""One copy that serves filters on either key."""

from __future__ import annotations

from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quotaline.sinks.clustered import write_interleaved


def table(spark, hot):
    """Reps and days; with ``hot``, a third of the rows on one rep and another third on one day."""
    rep = F.format_string("R%05d", F.pmod(F.xxhash64("id"), F.lit(500)))
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1400)).cast("int"))
    if hot:
        rep = F.when(F.col("id") % 3 == 0, "R00007").otherwise(rep)
        day = F.when(F.col("id") % 3 == 1, F.lit("2021-05-05").cast("date")).otherwise(day)
    return spark.range(0, 60_000, 1, 6).select(F.concat(F.lit("I"), "id").alias("invoice_id"), rep.alias("rep_id"), day.alias("invoice_date"))


def opened(files, column, low, high):
    """Files whose bounds a filter does not rule out."""
    spans = [pq.read_table(f, columns=[column]).column(0).to_pandas().dropna() for f in files]
    return sum(len(s) > 0 and s.min() <= high and s.max() >= low for s in spans)


@pytest.mark.parametrize("hot", [False, True])
def test_either_filter_opens_few_files(spark, tmp_path, hot):
    from datetime import date

    write_interleaved(table(spark, hot), str(tmp_path / "t"), ["invoice_date", "rep_id"], "invoice_id", 256)
    files = sorted(Path(tmp_path / "t").glob("*.parquet"))
    sizes = [pq.read_metadata(f).num_rows for f in files]
    assert sum(sizes) == 60_000 and 256 * 0.9 < len(files) < 2 * 256 and max(sizes) < 3 * 60_000 / 256
    for rep in ("R00123", "R00400"):
        assert opened(files, "rep_id", rep, rep) < len(files) / 4
    for month in ((date(2020, 6, 1), date(2020, 6, 30)), (date(2023, 2, 1), date(2023, 2, 28))):
        assert opened(files, "invoice_date", *month) < len(files) / 4
    got = spark.read.parquet(str(tmp_path / "t"))
    assert got.exceptAll(table(spark, hot)).count() == 0


def test_nulls_ties_and_empty_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", None, 1), (None, None, 2), ("a", "x", 3), ("a", "x", 3), (None, "y", None)], "rep_id string, k string, id int")
    for some in (rows, rows.limit(0), rows.where("rep_id IS NULL")):
        write_interleaved(some, str(tmp_path / "t"), ["rep_id", "k"], "id", 4)
        assert sorted(map(str, spark.read.parquet(str(tmp_path / "t")).collect())) == sorted(map(str, some.collect()))
