"""Profile of the raw entities, before any cleaning."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaline.sources import schemas as S

PROFILED = {
    "sales_reps": "region",
    "customers": "tier",
    "invoices": "status",
    "orders": "ship_status",
    "deals": "stage",
}


def _stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def profile_counts(raw: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of each entity."""
    return _stack([raw[e].agg(F.count("*").alias("n")).select(F.lit(e).alias("entity"), "n") for e in PROFILED])


def profile_values(raw: Mapping[str, DataFrame]) -> DataFrame:
    """How often each value of one telling column per entity occurs; nulls are not counted."""
    parts = [
        raw[entity]
        .filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count("*").alias("n"))
        .select(F.lit(entity).alias("entity"), F.lit(column).alias("field"), "value", "n")
        for entity, column in PROFILED.items()
    ]
    return _stack(parts).orderBy("entity", F.desc("n"), "value")


def raw_total_invoiced(invoices: DataFrame) -> DataFrame:
    """Raw invoice amounts, cancelled ones included."""
    return invoices.agg(F.sum("invoice_amount").alias("total_invoiced"))


def raw_total_recognized(invoices: DataFrame) -> DataFrame:
    """Raw amounts times recognized part, without rounding to cents."""
    return invoices.agg(F.sum(F.col("invoice_amount") * F.col("revenue_recognized_pct")).alias("total_recognized"))


def raw_total_pipeline(deals: DataFrame) -> DataFrame:
    """Raw deal amounts outside the two closed stages; a deal without a stage counts as open."""
    closed = F.coalesce(F.col("stage").isin(S.STAGE_WON, S.STAGE_LOST), F.lit(False))
    return deals.filter(~closed).agg(F.sum("deal_amount").alias("total_pipeline"))
