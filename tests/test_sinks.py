"""Writers: layout, snapshots, application tables and CSV."""

from concurrent.futures import ThreadPoolExecutor
from datetime import date
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quotaline.operators import serving
from quotaline.plans import reports, scratch
from quotaline.sinks import app_tables
from quotaline.sinks.clustered import write_clustered
from quotaline.sinks.csv_report import export_csv
from quotaline.sinks.snapshot import jdbc_options, read_gold, snapshot_sync
from quotaline.sources.schemas import GOLD_KEY, GOLD_LAYOUT, SERVING_LAYOUT
from tests.conftest import day, dec, moment


def test_clustered_files_are_sorted_and_hot_key_is_split(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200kb")
    try:
        rows = spark.range(0, 60_000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 200).alias("k"),
            F.sha2(F.col("id").cast("string"), 256).alias("payload"),
        )
        write_clustered(rows, str(tmp_path / "t"), ["k"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 60_000
    hot = back.filter("k = 7").select(F.input_file_name()).distinct().count()
    assert hot > 1  # one key in several files, not in one task
    for file in Path(tmp_path / "t").glob("*.parquet"):
        keys = [r.k for r in spark.read.parquet(str(file)).select("k").collect()]
        assert keys == sorted(keys)


def test_snapshot_replaces_the_copies(spark, frames, tmp_path):
    def tables(n):
        return {
            name: spark.range(n).select("id", *[F.col("id").alias(c) for c in {*SERVING_LAYOUT[name], GOLD_KEY[name]}])
            for name in GOLD_LAYOUT
        }

    for n in (5, 4, 3):
        snapshot_sync(tables(n), str(tmp_path))
    assert {n: df.count() for n, df in read_gold(spark, str(tmp_path)).items()} == dict.fromkeys(GOLD_LAYOUT, 3)
    assert len(list(tmp_path.glob("version-*"))) == 2  # the present copies and those before
    broken = tables(2) | {"gold_category_summary": spark.range(2)}
    with pytest.raises(PySparkException):
        snapshot_sync(broken, str(tmp_path))
    assert {n: df.count() for n, df in read_gold(spark, str(tmp_path)).items()} == dict.fromkeys(GOLD_LAYOUT, 3)
    with pytest.raises(FileNotFoundError):
        read_gold(spark, str(tmp_path / "nothing"))


def test_serving_copy_skips_files_for_a_rep(spark, tmp_path):
    rows = spark.range(0, 40_000, 1, 8).select(
        F.concat(F.lit("I"), "id").alias("invoice_id"), F.concat(F.lit("R"), F.col("id") % 40).alias("rep_id"),
        F.concat(F.lit("Z"), F.col("id") % 4).alias("rep_region"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 300).cast("int")).alias("invoice_date"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is too small for several files
    try:
        write_clustered(rows, str(tmp_path / "t"), SERVING_LAYOUT["gold_invoice_details"], GOLD_KEY["gold_invoice_details"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = list((tmp_path / "t").glob("*.parquet"))
    spans = [pq.read_table(f, columns=["rep_id", "rep_region"]).to_pandas() for f in files]
    assert len(files) >= 6 and sum(map(len, spans)) == 40_000

    def read(column, value):  # what the minimum and maximum of a file let a reader skip is not counted
        return sum(s[column].min() <= value <= s[column].max() for s in spans)

    assert read("rep_region", "Z1") <= len(files) // 2
    assert sum((s["rep_id"].min() <= "R5" <= s["rep_id"].max()) and (s["rep_region"].min() <= "Z1" <= s["rep_region"].max()) for s in spans) <= 3


def test_jdbc_options_keep_the_table_and_cap_connections():
    options = jdbc_options("jdbc:x", "s.t", connections=4, user="u")
    assert options == {
        "url": "jdbc:x", "dbtable": "s.t", "truncate": "true", "numPartitions": "4", "batchsize": "10000", "user": "u",
    }


@pytest.fixture
def namespace(spark, tmp_path):
    name = "ns_" + tmp_path.name.replace("-", "_")
    app_tables.ensure_namespace(spark, name, str(tmp_path / "ns"))
    app_tables.ensure_app_tables(spark, name)
    yield name
    spark.sql(f"DROP SCHEMA {name} CASCADE")


def test_app_tables_append(spark, frames, namespace):
    app_tables.ensure_namespace(spark, namespace)
    rows = frames.feedback({"rep_id": "R1", "submitted_at": moment("2024-01-01"), "adjustments": [("D1", 1, 2)]})
    app_tables.append_feedback(rows, namespace)
    app_tables.append_feedback(app_tables.adjustments_as_json(rows.drop("submitted_at")), namespace)
    app_tables.ensure_app_tables(spark, namespace)  # keeps what is there
    back = serving.read_feedback(spark.table(f"{namespace}.sales_feedback")).collect()
    assert len({r.id for r in back}) == 2 and None not in {r.id for r in back}
    assert back[0].submitted_at > moment("2025-01-01") and back[1].submitted_at == moment("2024-01-01")
    assert [r.adjustments[0].adjusted_forecast for r in back] == [dec("2.00")] * 2


def test_invalid_submissions_are_refused(spark, frames, namespace):
    def append(text):
        rows = spark.createDataFrame([("R1", text)], "rep_id string, adjustments string")
        app_tables.append_feedback(rows, namespace)

    good = '{"deal_id":"D1","original_forecast":1,"adjusted_forecast":2}'
    bad = [f"[{good}", '[{"deal_id":"D1","original_forecast":"x","adjusted_forecast":2}]', "nonsense", f"[{good},{good}]"]
    bad += [f"[{good.replace(':2', ':-2')}]", f"[{good.replace(':2', ':null')}]", '[{"original_forecast":1,"adjusted_forecast":2}]']
    for text in bad:
        with pytest.raises(Exception, match="MALFORMED|malformed|adjust"):
            append(text)
    append(f"[{good}]")
    append(None)
    assert spark.table(f"{namespace}.sales_feedback").count() == 2
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        serving.read_feedback(spark.createDataFrame([("R1", bad[0], moment("2024-01-01"))], "rep_id string, adjustments string, submitted_at timestamp")).collect()


def test_concurrent_appends_store_every_row(spark, frames, namespace):
    def writer(n):
        for k in range(5):
            app_tables.append_feedback(frames.feedback({"rep_id": f"R{n}", "submitted_at": moment("2024-01-01"), "adjustments": [(f"D{k}", 1, 2)]}), namespace)

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(writer, range(8)))
    spark.catalog.refreshTable(f"{namespace}.sales_feedback")
    rows = spark.table(f"{namespace}.sales_feedback").collect()
    assert len(rows) == len({r.id for r in rows}) == 40
    assert app_tables.compact(spark, namespace, "sales_feedback") >= 40
    table = spark.table(f"{namespace}.sales_feedback")
    assert {r.id for r in table.collect()} == {r.id for r in rows} and len(table.inputFiles()) == 1
    assert app_tables.compact(spark, namespace, "sales_feedback") == 0


def test_override_append(spark, namespace):
    row = spark.createDataFrame([(5, "note", "Manager")], "manager_override_pct int, manager_notes string, approved_by string")
    app_tables.append_override(row, namespace)
    stored = spark.table(f"{namespace}.manager_overrides").first()
    assert (stored.manager_override_pct, stored.manager_notes, stored.approved_by) == (5, "note", "Manager")
    assert stored.id and stored.approved_at


def csv_text(folder) -> str:
    (part,) = Path(folder).glob("part-*.csv")
    return part.read_text()


def test_csv_equals_pandas(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, 'say "hi", twice', "x", dec("1.50")), (2, None, "", dec("2.00")), (3, "plain", "a,b", None)],
        "id int, a string, b string, c decimal(18,2)",
    ).coalesce(1)
    export_csv(rows, str(tmp_path / "r.csv"))
    assert csv_text(tmp_path / "r.csv") == rows.toPandas().to_csv(index=False)


def test_reports(spark, frames, tmp_path):
    summary = frames.summary(
        {"rep_id": "R1", "region": "EAST", "month_date": day("2024-01-01"), "total_invoiced": 5},
        {"rep_id": "R1", "region": "EAST", "month_date": day("2024-02-01")},
        {"rep_id": "R2", "region": "WEST", "month_date": day("2024-02-01")},
    )
    tables = {"gold_rep_monthly_summary": summary}
    assert reports.report(tables, reports.MONTHLY).count() == 3
    assert reports.report(tables, reports.FORECAST, region="EAST").count() == 2
    assert reports.report(tables, reports.MONTHLY, start=date(2024, 2, 1)).count() == 2
    assert reports.report(tables, reports.MONTHLY, "R1", end=date(2024, 1, 31)).count() == 1
    assert reports.report_row_count(reports.report(tables, reports.MONTHLY, "R1")).first().n == 2
    path = reports.write_report(
        reports.report(tables, reports.MONTHLY, "R1").coalesce(1), str(tmp_path), reports.MONTHLY, date(2024, 3, 5)
    )
    assert path.endswith("/sales_monthly_sales_summary_20240305.csv")
    assert csv_text(path).splitlines()[1].startswith("R1,,EAST,2024-01-01,5.00")


class Session:
    """Stands in for a session with the given settings."""

    def __init__(self, **settings):
        self.conf = {key.replace("_", "."): value for key, value in settings.items()}


def test_scratch_folder_follows_the_session():
    shared = Session(spark_checkpoint_dir="/shared/place/", spark_master="yarn")
    assert scratch.scratch_folder(shared, "x").startswith("/shared/place/quotaline/x-")
    assert scratch.scratch_folder(shared, "x") != scratch.scratch_folder(shared, "x")
    with pytest.raises(ValueError):
        scratch.scratch_folder(Session(spark_master="yarn"), "x")
    assert "/quotaline/x-" in scratch.scratch_folder(Session(spark_master="local[8]"), "x")
    assert scratch.scratch_folder(shared, "x", "/given").startswith("/given/quotaline/x-")
    scratch._made.clear()


def test_scratch_folders_can_be_discarded(spark, tmp_path):
    folder = scratch.scratch_folder(spark, "x", str(tmp_path))
    spark.range(1).write.parquet(folder)
    scratch.discard(spark)
    assert not Path(folder).exists()
