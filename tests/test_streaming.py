"""Ingest: every file once, also after failures."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quotaline.plans import refresh as plan
from quotaline.plans.refresh import refresh, update_gold
from quotaline.sinks import clustered as layout
from quotaline.sinks import folders
from quotaline.sinks.snapshot import read_gold
from quotaline.sources.landing import add_files, land_parquet
from quotaline.streaming import bronze


def paths(folder):
    return str(folder / "landing" / "orders"), str(folder / "bronze"), str(folder / "checkpoint")


def rows(frames, first, last):
    return frames.orders(*[{"order_id": f"O{i}"} for i in range(first, last)])


def ids(spark, folder):
    return sorted(int(r.order_id[1:]) for r in bronze.read_bronze(spark, "orders", str(folder / "bronze")).collect())


def test_files_are_ingested_once(spark, frames, tmp_path):
    land_parquet({"orders": rows(frames, 0, 10)}, str(tmp_path / "landing"))
    for _ in range(2):
        bronze.ingest(spark, "orders", *paths(tmp_path))
        assert ids(spark, tmp_path) == list(range(10))
    add_files("orders", rows(frames, 10, 13), str(tmp_path / "landing"))
    bronze.ingest(spark, "orders", *paths(tmp_path))
    assert ids(spark, tmp_path) == list(range(13))
    read = bronze.read_bronze(spark, "orders", str(tmp_path / "bronze"))
    assert read.columns[-2:] == ["_ingested_at", "_source_file"]
    assert read.filter("_ingested_at IS NULL OR _source_file NOT LIKE '%.parquet'").count() == 0


def test_replaced_landing_files_are_new_files(spark, frames, tmp_path):
    for _ in range(2):
        land_parquet({"orders": rows(frames, 0, 5)}, str(tmp_path / "landing"))
        bronze.ingest(spark, "orders", *paths(tmp_path))
    assert ids(spark, tmp_path) == sorted(list(range(5)) * 2)


def test_failed_batch_is_repeated_without_doubles(spark, frames, tmp_path, monkeypatch):
    land_parquet({"orders": rows(frames, 0, 10)}, str(tmp_path / "landing"))

    def fails_after_writing(df, keys):
        layout.clustered(df, keys).write.mode("overwrite").parquet(f"{tmp_path}/bronze/{bronze.BATCH}=0")
        raise RuntimeError("lost")

    monkeypatch.setattr(bronze, "clustered", fails_after_writing)
    with pytest.raises(Exception, match="lost"):
        bronze.ingest(spark, "orders", *paths(tmp_path))
    monkeypatch.undo()
    bronze.ingest(spark, "orders", *paths(tmp_path))
    assert ids(spark, tmp_path) == list(range(10))


def test_batch_without_commit_is_replaced(spark, frames, tmp_path):
    land_parquet({"orders": rows(frames, 0, 10)}, str(tmp_path / "landing"))
    bronze.ingest(spark, "orders", *paths(tmp_path))
    commits = Path(tmp_path / "checkpoint" / "commits")
    for commit in commits.glob("*0*"):
        commit.unlink()
    bronze.ingest(spark, "orders", *paths(tmp_path))
    assert ids(spark, tmp_path) == list(range(10))


def test_backlog_is_cut_into_batches(spark, frames, tmp_path):
    for first in range(0, 12, 3):
        add_files("orders", rows(frames, first, first + 3).coalesce(1), str(tmp_path / "landing"))
    bronze.ingest(spark, "orders", *paths(tmp_path), max_bytes_per_trigger=1)
    assert ids(spark, tmp_path) == list(range(12))
    assert len(list((tmp_path / "bronze").glob(f"{bronze.BATCH}=*"))) == 4


def test_refresh_is_incremental_and_dedupes_on_request(spark, frames, tmp_path):
    raw = {
        "sales_reps": frames.reps({"rep_id": "R1", "rep_name": "Ann"}),
        "customers": frames.customers({"customer_id": "C1", "customer_name": "Acme"}),
        "invoices": frames.invoices({}, {"invoice_id": "I2"}),
        "orders": frames.orders({}),
        "deals": frames.deals({}),
    }
    landing, lake, serving = (str(tmp_path / n) for n in ("landing", "lake", "serving"))
    land_parquet(raw, landing)
    gold = refresh(spark, landing, lake, serving)
    assert gold["gold_invoice_details"].count() == 2
    assert read_gold(spark, serving)["gold_rep_monthly_summary"].count() == 2
    add_files("invoices", frames.invoices({}, {"invoice_id": "I3"}), landing)
    assert refresh(spark, landing, lake)["gold_invoice_details"].count() == 4
    assert refresh(spark, landing, lake, dedupe=True)["gold_invoice_details"].count() == 3


def test_late_file_with_an_old_date_arrives(spark, frames, tmp_path):
    land_parquet({"orders": rows(frames, 0, 5)}, str(tmp_path / "landing"))
    bronze.ingest(spark, "orders", *paths(tmp_path))
    before = set((tmp_path / "landing" / "orders").glob("*.parquet"))
    add_files("orders", rows(frames, 5, 8), str(tmp_path / "landing"))
    for file in set((tmp_path / "landing" / "orders").glob("*.parquet")) - before:
        os.utime(file, (1_500_000_000, 1_500_000_000))
    bronze.ingest(spark, "orders", *paths(tmp_path))
    assert ids(spark, tmp_path) == list(range(8))


def test_undeclared_columns_are_kept(spark, frames, tmp_path):
    land_parquet({"orders": rows(frames, 0, 2)}, str(tmp_path / "landing"))
    bronze.ingest(spark, "orders", *paths(tmp_path))
    add_files("orders", rows(frames, 2, 4).withColumn("channel", F.lit("web")), str(tmp_path / "landing"))
    bronze.ingest(spark, "orders", *paths(tmp_path))
    read = bronze.read_bronze(spark, "orders", str(tmp_path / "bronze"))
    assert {(r.order_id, r.channel) for r in read.collect()} == {("O0", None), ("O1", None), ("O2", "web"), ("O3", "web")}
    assert read.columns[-2:] == ["_ingested_at", "_source_file"]


def test_files_can_be_archived(spark, frames, tmp_path):
    for first in (0, 3, 6):
        add_files("orders", rows(frames, first, first + 3).coalesce(1), str(tmp_path / "landing"))
        bronze.ingest(spark, "orders", *paths(tmp_path), archive=str(tmp_path / "archive"))
    assert ids(spark, tmp_path) == list(range(9))


def raw(frames, **changed):
    tables = {
        "sales_reps": frames.reps({"rep_id": "R1", "rep_name": "Ann"}),
        "customers": frames.customers({"customer_id": "C1", "customer_name": "Acme"}),
        "invoices": frames.invoices({"invoice_id": "I1"}, {"invoice_id": "I2", "invoice_date": "2024-02-01"}),
        "orders": frames.orders({}),
        "deals": frames.deals({}),
    }
    return tables | changed


def test_empty_entities_refresh(spark, frames, tmp_path):
    landing, lake, serving = (str(tmp_path / n) for n in ("landing", "lake", "serving"))
    tables = raw(frames)
    del tables["deals"], tables["orders"]
    (tmp_path / "landing" / "deals").mkdir(parents=True)  # an empty folder, and none at all for the orders
    land_parquet(tables, landing)
    gold = refresh(spark, landing, lake, serving)
    assert {n: df.count() for n, df in gold.items()} == {
        "gold_rep_monthly_summary": 2, "gold_active_deals": 0, "gold_invoice_details": 2, "gold_category_summary": 2,
    }
    assert read_gold(spark, serving)["gold_active_deals"].columns == gold["gold_active_deals"].columns


def test_failed_entity_stops_the_others(spark, frames, tmp_path):
    landing, lake = str(tmp_path / "landing"), str(tmp_path / "lake")
    land_parquet(raw(frames), landing)
    refresh(spark, landing, lake)
    add_files("invoices", frames.invoices({"invoice_id": "I9"}), landing)
    bad = tmp_path / "landing" / "sales_reps" / "bad.parquet"
    bad.write_text("no parquet")
    with pytest.raises(Exception):
        refresh(spark, landing, lake)
    assert not spark.streams.active
    assert read_gold(spark, lake)["gold_invoice_details"].count() == 2  # as before
    bad.unlink()
    Path(f"{bad.parent}/.bad.parquet.crc").unlink(missing_ok=True)


def test_second_refresh_rewrites_the_touched_months_only(spark, frames, tmp_path):
    landing, lake = str(tmp_path / "landing"), str(tmp_path / "lake")
    land_parquet(raw(frames), landing)
    refresh(spark, landing, lake)
    first = folders.published(spark, lake)
    silver = {f: f.stat().st_mtime_ns for f in (tmp_path / "lake").glob("silver_*/**/*.parquet")}
    add_files("invoices", frames.invoices({"invoice_id": "I3", "invoice_date": "2024-02-20", "invoice_amount": 7.0}), landing)
    gold = refresh(spark, landing, lake)
    second = folders.published(spark, lake)
    for table, parts in second["tables"].items():
        for month, folder in parts.items():
            touched = table != "gold_active_deals" and month == "2024-02"
            assert (folder == first["tables"][table].get(month)) != touched, (table, month)
    assert all(f.exists() and f.stat().st_mtime_ns == at for f, at in silver.items())
    assert gold["gold_invoice_details"].count() == 3
    whole = {n: sorted(map(str, df.collect())) for n, df in gold.items()}
    plan.refresh_gold(plan.read_silver(spark, lake), str(tmp_path / "again"))
    assert whole == {n: sorted(map(str, df.collect())) for n, df in read_gold(spark, str(tmp_path / "again")).items()}
    assert update_gold(spark, lake) == [] and folders.published(spark, lake)["number"] == second["number"]


def test_new_dimension_rows_recompute_all(spark, frames, tmp_path):
    landing, lake = str(tmp_path / "landing"), str(tmp_path / "lake")
    land_parquet(raw(frames, customers=frames.customers({"customer_id": "C9", "customer_name": "Other"})), landing)
    assert refresh(spark, landing, lake)["gold_invoice_details"].first().customer_name is None
    add_files("customers", frames.customers({"customer_id": "C1", "customer_name": "Acme"}), landing)
    assert {r.customer_name for r in refresh(spark, landing, lake)["gold_invoice_details"].collect()} == {"Acme"}


def test_failure_in_the_middle_leaves_the_old_tables(spark, frames, tmp_path, monkeypatch):
    landing, lake, serving = (str(tmp_path / n) for n in ("landing", "lake", "serving"))
    land_parquet(raw(frames), landing)
    refresh(spark, landing, lake, serving)
    add_files("invoices", frames.invoices({"invoice_id": "I3"}), landing)
    write = plan._write_months

    def fails(df, table, path):
        if table == "gold_category_summary":
            raise RuntimeError("lost")
        write(df, table, path)

    monkeypatch.setattr(plan, "_write_months", fails)
    with pytest.raises(RuntimeError, match="lost"):
        refresh(spark, landing, lake, serving)
    for root in (lake, serving):
        tables = read_gold(spark, root)
        assert tables["gold_invoice_details"].count() == 2 and tables["gold_category_summary"].agg({"invoice_count": "sum"}).first()[0] == 2
    monkeypatch.undo()
    refresh(spark, landing, lake, serving)
    assert read_gold(spark, serving)["gold_invoice_details"].count() == 3
