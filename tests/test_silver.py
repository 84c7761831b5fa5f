"""Cleaning rules: what is kept, how it is typed, and nulls."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quotaline.operators import silver
from tests.conftest import day, dec


def ids(df, column):
    return sorted(r[0] for r in df.select(column).collect())


def test_reps_and_customers_need_id_and_name(frames):
    reps = frames.reps({"rep_id": "R1", "rep_name": "A"}, {"rep_id": None, "rep_name": "B"}, {"rep_id": "R3"})
    assert ids(silver.silver_sales_reps(reps), "rep_id") == ["R1"]
    customers = frames.customers({"customer_id": "C1", "customer_name": "A"}, {"customer_id": "C2"}, {"customer_name": "X"})
    assert ids(silver.silver_customers(customers), "customer_id") == ["C1"]


def test_invoices_keep_rule(frames):
    rows = frames.invoices(
        {"invoice_id": "ok"},
        {"invoice_id": None},
        {"invoice_id": "zero", "invoice_amount": 0.0},
        {"invoice_id": "negative", "invoice_amount": -5.0},
        {"invoice_id": "no amount", "invoice_amount": None},
        {"invoice_id": "cancelled", "status": "Cancelled"},
        {"invoice_id": "no status", "status": None},
        {"invoice_id": "tiny", "invoice_amount": 0.004},
    )
    kept = silver.silver_invoices(rows)
    assert ids(kept, "invoice_id") == ["ok", "tiny"]
    assert kept.filter("invoice_id = 'tiny'").first()["invoice_amount"] == dec("0.00")


def test_recognized_revenue_is_rounded_as_a_decimal(frames):
    rows = frames.invoices({"invoice_amount": 10.10, "revenue_recognized_pct": 0.25}, {"invoice_amount": 1.005})
    first, second = silver.silver_invoices(rows).collect()
    assert first["recognized_revenue"] == dec("2.53")  # 2.525 half up
    assert second["invoice_amount"] == dec("1.01")
    assert dict(silver.silver_invoices(rows).dtypes)["recognized_revenue"] == "decimal(23,2)"


def test_null_recognized_part_stays_null(frames):
    row = silver.silver_invoices(frames.invoices({"revenue_recognized_pct": None})).first()
    assert row["recognized_revenue"] is None


def test_deals_keep_rule(frames):
    rows = frames.deals(
        {"deal_id": "open"}, {"deal_id": "won", "stage": "Closed Won"}, {"deal_id": "lost", "stage": "Closed Lost"},
        {"deal_id": "none", "stage": None}, {"deal_id": "other", "stage": "Parked"},
    )
    assert ids(silver.silver_deals(rows), "deal_id") == ["open", "other", "won"]


def test_orders_types_and_missing_ship_date(frames):
    row = silver.silver_orders(frames.orders({"quantity": 7, "ship_date": None})).first()
    assert row["quantity"] == 7 and row["ship_date"] is None and row["order_date"] == day("2024-01-15")
    assert dict(silver.silver_orders(frames.orders({})).dtypes)["quantity"] == "int"


def test_invalid_date_raises_or_becomes_null(frames):
    rows = frames.invoices({"invoice_date": "not a day"})
    with pytest.raises(PySparkException):
        silver.silver_invoices(rows).collect()
    assert silver.silver_invoices(rows, strict=False).first()["invoice_date"] is None


def test_ingest_time_is_carried_and_source_file_is_not(frames):
    rows = frames.orders({}).withColumns({"_ingested_at": F.current_timestamp(), "_source_file": F.lit("f")})
    columns = silver.silver_orders(rows).columns
    assert columns[-1] == "_ingested_at" and "_source_file" not in columns


def test_newest_by_key_keeps_the_last_ingested(frames):
    rows = frames.orders({"quantity": 1}, {"quantity": 2}, {"order_id": "O2", "quantity": 3})
    stamped = silver.silver_orders(rows).withColumn("_ingested_at", F.timestamp_seconds(F.lit(10) - F.col("quantity")))
    kept = silver.newest_by_key(stamped, "order_id")
    assert kept.columns == stamped.columns
    assert sorted((r.order_id, r.quantity) for r in kept.collect()) == [("O1", 1), ("O2", 3)]
