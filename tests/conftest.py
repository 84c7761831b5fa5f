from __future__ import annotations

import sys
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quotaline.session import configure  # noqa: E402
from quotaline.sources import schemas as S  # noqa: E402

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("session")
    builder = (
        configure(SparkSession.builder.master("local[8]").appName("quotaline-tests"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def text(day) -> str | None:
    return None if day is None else str(day)


def dec(value) -> Decimal | None:
    return None if value is None else Decimal(str(value))


class Frames:
    """Small frames with defaults for the columns a test does not care about."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _raw(self, schema, defaults: dict, rows: list[dict]):
        full = [{**{n: None for n in schema.names}, **defaults, **row} for row in rows]
        return self.spark.createDataFrame([tuple(r[n] for n in schema.names) for r in full], schema)

    def reps(self, *rows):
        return self._raw(S.SALES_REPS, {"hire_date": "2020-01-01", "annual_quota": 100.0, "region": "EAST"}, list(rows))

    def customers(self, *rows):
        return self._raw(S.CUSTOMERS, {"created_date": "2020-01-01"}, list(rows))

    def invoices(self, *rows):
        defaults = {
            "invoice_id": "I1", "rep_id": "R1", "customer_id": "C1", "invoice_date": "2024-01-15",
            "invoice_amount": 100.0, "status": "Shipped", "revenue_recognized_pct": 1.0, "product_category": "Networking",
        }
        return self._raw(S.INVOICES, defaults, list(rows))

    def orders(self, *rows):
        defaults = {
            "order_id": "O1", "rep_id": "R1", "customer_id": "C1", "order_date": "2024-01-15", "order_amount": 100.0,
            "ship_status": "Shipped", "quantity": 1, "is_confirmed": True,
        }
        return self._raw(S.ORDERS, defaults, list(rows))

    def deals(self, *rows):
        defaults = {
            "deal_id": "D1", "rep_id": "R1", "customer_id": "C1", "deal_name": "Deal", "stage": "Discovery",
            "deal_amount": 100.0, "forecasted_amount": 50.0, "probability": 0.5, "created_date": "2024-01-01",
            "expected_close_date": "2024-02-10",
        }
        return self._raw(S.DEALS, defaults, list(rows))

    def feedback(self, *rows):
        full = []
        for row in rows:
            row = {"id": None, "rep_name": None, "confidence": None, "risks": None, "upside": None, "notes": None, **row}
            row["adjustments"] = [(d, dec(a), dec(b)) for d, a, b in row["adjustments"]]
            full.append(tuple(row[n] for n in S.SALES_FEEDBACK.names))
        return self.spark.createDataFrame(full, S.SALES_FEEDBACK)

    def summary(self, *rows):
        schema = (
            "rep_id string, rep_name string, region string, role string, annual_quota decimal(18,2), month_date date, "
            "total_invoiced decimal(28,2), total_recognized decimal(28,2), total_confirmed_orders decimal(28,2), "
            "shipped_revenue decimal(28,2), total_pipeline_value decimal(28,2), total_weighted_pipeline decimal(28,2), "
            "blended_forecast decimal(28,2)"
        )
        names = [part.split()[0] for part in schema.split(", ")]
        money = [n for n in names if n.startswith(("total_", "shipped_", "blended_"))]
        full = []
        for row in rows:
            row = {**{n: None for n in names}, **{m: 0 for m in money}, **row}
            full.append(tuple(dec(row[n]) if n in money else row[n] for n in names))
        return self.spark.createDataFrame(full, schema)


@pytest.fixture(scope="session")
def frames(spark):
    return Frames(spark)


def day(value: str) -> date:
    return date.fromisoformat(value)


def moment(value: str) -> datetime:
    return datetime.fromisoformat(value)


def executed_plan(df) -> str:
    """The plan adaptive execution ended with."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
