"""Parameterised reads over the gold tables.

Every ordering ends in the row's key: results are deterministic, and the rows of one hot month or date still spread
over many sort partitions. Nulls come last ascending and first descending.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotaline.operators.gold import gold_category_summary
from quotaline.sinks import manifest
from quotaline.sinks.app_tables import decoded
from quotaline.sources import schemas as S

DRILL_DOWN_ROWS = 500


def build_filter(rep_id: str | None = None, region: str | None = None, region_column: str = "rep_region") -> Column | None:
    """Predicate for a rep and a region; an empty value, or the region "All", filters nothing."""
    tests = []
    if rep_id:
        tests.append(F.col("rep_id") == rep_id)
    if region and region != S.ALL:
        tests.append(F.col(region_column) == region)
    return reduce(and_, tests) if tests else None


def _filtered(df: DataFrame, predicate: Column | None) -> DataFrame:
    return df if predicate is None else df.filter(predicate)


def list_sales_reps(summary: DataFrame) -> DataFrame:
    """The reps seen in the summary, by name."""
    reps = summary.select("rep_id", "rep_name", "region", "role", "annual_quota").distinct()
    return reps.orderBy(F.asc_nulls_last("rep_name"), F.asc_nulls_last("rep_id"))


def list_regions(summary: DataFrame) -> DataFrame:
    """The region selector: "All", then the regions of the reps in order."""
    regions = summary.filter(F.col("region").isNotNull()).select("region").distinct()
    everything = summary.sparkSession.createDataFrame([(S.ALL,)], "region string")
    return (
        everything.withColumn("place", F.lit(0))
        .union(regions.withColumn("place", F.lit(1)))
        .orderBy("place", "region")
        .select("region")
    )


def rep_name_lookup(summary: DataFrame) -> DataFrame:
    """One rep id per name, by name. Reps who share a name collapse to the last id; key on ``rep_id`` to avoid it."""
    named = summary.filter(F.col("rep_name").isNotNull())
    return named.groupBy("rep_name").agg(F.max("rep_id").alias("rep_id")).orderBy("rep_name")


def monthly_summary(summary: DataFrame, rep_id: str | None = None, region: str | None = None) -> DataFrame:
    rows = _filtered(summary, build_filter(rep_id, region, "region")).select(
        "rep_id", "rep_name", "region", "month_date", "total_invoiced", "total_recognized", "total_confirmed_orders",
        "shipped_revenue", "total_pipeline_value", "total_weighted_pipeline", "blended_forecast", "annual_quota",
    )
    return rows.orderBy(F.asc_nulls_last("month_date"), F.asc_nulls_last("rep_id"))


def active_deals(deals: DataFrame, rep_id: str | None = None, region: str | None = None) -> DataFrame:
    return _filtered(deals, build_filter(rep_id, region)).orderBy(F.asc_nulls_last("expected_close_date"), "deal_id")


def newest_first() -> list[Column]:
    """The order of ``invoice_details``."""
    return [F.desc_nulls_first("invoice_date"), F.col("invoice_id")]


def invoice_details(
    invoices: DataFrame, rep_id: str | None = None, region: str | None = None, rows: int | None = DRILL_DOWN_ROWS
) -> DataFrame:
    """The newest ``rows`` invoices: a top-k, so each task keeps only its own best rows. With None, all of them."""
    ordered = _filtered(invoices, build_filter(rep_id, region)).orderBy(*newest_first())
    return ordered if rows is None else ordered.limit(rows)


def newest_invoices(
    facts: DataFrame, reps: DataFrame, rep_id: str | None = None, region: str | None = None, rows: int = DRILL_DOWN_ROWS
) -> DataFrame:
    """The facts that ``invoice_details`` can need for its newest ``rows``: told before their names are looked up.

    A lookup keeps every fact and leaves its day and id, so the newest detail rows are those of the newest facts.
    """
    own = _filtered(facts, build_filter(rep_id))
    if region and region != S.ALL:
        own = own.join(reps.where(F.col("region") == region).select("rep_id"), "rep_id", "left_semi").select(*facts.columns)
    return own.orderBy(*newest_first()).limit(rows)


def published_invoice_details(
    spark: SparkSession, root: str, rep_id: str | None = None, region: str | None = None, rows: int = DRILL_DOWN_ROWS
) -> DataFrame:
    """``invoice_details`` of the gold tables published under ``root``, from the files that can hold the newest rows."""
    return manifest.newest(spark, root, "gold_invoice_details", "invoice_date", "invoice_id", rows, rep_id or None, build_filter(None, region))


def category_summary(
    categories: DataFrame, invoices: DataFrame | None = None, region: str | None = None
) -> DataFrame:
    """Category rows by month. With a region: the categories invoiced there, at their company-wide totals.

    The categories of the region are made distinct before the semi join, on the map side, so what is joined is the
    category list and not the invoices.
    """
    if region and region != S.ALL:
        sold = invoices.filter(F.col("rep_region") == region).select("product_category").distinct()
        categories = categories.join(sold, "product_category", "left_semi").select(*categories.columns)
    return categories.orderBy(F.asc_nulls_last("month_date"), F.asc_nulls_last("product_category"))


def category_summary_within(invoices: DataFrame, region: str) -> DataFrame:
    """Category rows counting only the invoices of one region (opt-in; see ``category_summary``)."""
    rows = gold_category_summary(invoices.filter(F.col("rep_region") == region))
    return rows.orderBy(F.asc_nulls_last("month_date"), F.asc_nulls_last("product_category"))


def read_feedback(submissions: DataFrame, rep_id: str | None = None) -> DataFrame:
    """Feedback submissions, newest first, with the adjustments decoded when they are stored as JSON text."""
    if isinstance(submissions.schema["adjustments"].dataType, T.StringType):
        submissions = submissions.withColumn("adjustments", decoded(F.col("adjustments")))
    ties = [c for c in ("rep_id", "id") if c in submissions.columns]
    return _filtered(submissions, build_filter(rep_id)).orderBy(F.desc_nulls_first("submitted_at"), *ties)
