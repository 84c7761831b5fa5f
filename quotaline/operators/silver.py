"""Cleaning and typing of the ingested entities.

Amounts are tested on the raw double, before rounding to cents, so 0.004 is kept and becomes 0.00. A null status,
stage or amount fails its test and the row is dropped. ``strict=False`` turns invalid date text into null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotaline.functions.typed import day, money, ratio
from quotaline.sources import schemas as S

INGEST_TIME, INGEST_BATCH = "_ingested_at", "ingest_batch"


def _carried(df: DataFrame) -> list[str]:
    """The time and the batch of the ingest are carried where the input has them; the source file is not."""
    return [c for c in (INGEST_TIME, INGEST_BATCH) if c in df.columns]


def silver_sales_reps(bronze: DataFrame, strict: bool = True) -> DataFrame:
    return bronze.filter(F.col("rep_id").isNotNull() & F.col("rep_name").isNotNull()).select(
        "rep_id", "rep_name", "email", "region", "role", "manager_name",
        day("hire_date", strict), money("annual_quota"), *_carried(bronze),
    )


def silver_customers(bronze: DataFrame, strict: bool = True) -> DataFrame:
    return bronze.filter(F.col("customer_id").isNotNull() & F.col("customer_name").isNotNull()).select(
        "customer_id", "customer_name", "vertical", "tier", "region", "assigned_rep_id",
        day("created_date", strict), *_carried(bronze),
    )


def _identified_and_positive(key: str, amount: str) -> Column:
    return F.col(key).isNotNull() & (F.col(amount) > 0)


def silver_invoices(bronze: DataFrame, strict: bool = True) -> DataFrame:
    kept = bronze.filter(
        _identified_and_positive("invoice_id", "invoice_amount") & (F.col("status") != S.STATUS_CANCELLED)
    )
    recognized = F.round(money("invoice_amount") * ratio("revenue_recognized_pct"), 2)
    return kept.select(
        "invoice_id", "customer_id", "rep_id", day("invoice_date", strict), money("invoice_amount"), "status",
        ratio("revenue_recognized_pct"), recognized.alias("recognized_revenue"),
        "product_category", "po_number", "payment_terms", *_carried(bronze),
    )


def silver_orders(bronze: DataFrame, strict: bool = True) -> DataFrame:
    return bronze.filter(_identified_and_positive("order_id", "order_amount")).select(
        "order_id", "customer_id", "rep_id", day("order_date", strict), money("order_amount"),
        day("ship_date", strict), "ship_status", "product_category",
        F.col("quantity").cast("int").alias("quantity"), "is_confirmed", *_carried(bronze),
    )


def silver_deals(bronze: DataFrame, strict: bool = True) -> DataFrame:
    kept = bronze.filter(_identified_and_positive("deal_id", "deal_amount") & (F.col("stage") != S.STAGE_LOST))
    return kept.select(
        "deal_id", "customer_id", "rep_id", "deal_name", "stage", money("deal_amount"),
        money("forecasted_amount"), ratio("probability"), "product_category",
        day("created_date", strict), day("expected_close_date", strict), "deal_type", "next_step", *_carried(bronze),
    )


KEPT = "kept"


def _missing(column: str) -> Column:
    return F.col(column).isNull()


def _no_amount(column: str) -> Column:
    return F.coalesce(~(F.col(column) > 0), F.lit(True))


def rejections(entity: str) -> dict[str, Column]:
    """Why an entity's rows are left out, in order: a row counts under the first that holds, and is kept if none does."""
    return {
        "sales_reps": lambda: {"no id": _missing("rep_id"), "no name": _missing("rep_name")},
        "customers": lambda: {"no id": _missing("customer_id"), "no name": _missing("customer_name")},
        "invoices": lambda: {"no id": _missing("invoice_id"), "no amount": _no_amount("invoice_amount"), "no status": _missing("status"), "cancelled": F.col("status") == S.STATUS_CANCELLED},
        "orders": lambda: {"no id": _missing("order_id"), "no amount": _no_amount("order_amount")},
        "deals": lambda: {"no id": _missing("deal_id"), "no amount": _no_amount("deal_amount"), "no stage": _missing("stage"), "lost": F.col("stage") == S.STAGE_LOST},
    }[entity]()


def counted(entity: str) -> list[Column]:
    """Aggregates that count an entity's raw rows by what becomes of them: kept, or the first reason that holds."""
    reasons = rejections(entity)
    fate = F.coalesce(*[F.when(test, F.lit(name)) for name, test in reasons.items()], F.lit(KEPT))
    return [F.count(F.when(fate == name, 1)).alias(name) for name in (KEPT, *reasons)]


def newest_by_key(df: DataFrame, key: str) -> DataFrame:
    """One row per key: the last ingested, ties broken by the row's values.

    Off by default in the refresh: ingested files that were landed twice are otherwise counted twice. The maximum is
    combined on the map side, so many copies of one key shrink before the shuffle.
    """
    first = [INGEST_TIME] if INGEST_TIME in df.columns else []
    rest = [c for c in df.columns if c not in {key, *first}]
    newest = df.groupBy(key).agg(F.max(F.struct(*first, *rest)).alias("row"))
    return newest.select(*[F.col(c) if c == key else F.col(f"row.{c}").alias(c) for c in df.columns])
