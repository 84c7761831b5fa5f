"""Dashboard aggregates over the serving reads. Rows without a group key are left out."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaline.functions.labels import compact_dollars, position_in
from quotaline.sources import schemas as S

KPIS = ("total_invoiced", "total_recognized", "total_confirmed_orders", "total_pipeline_value", "total_weighted_pipeline")


def _sums(*names: str) -> list:
    return [F.sum(n).alias(n) for n in names]


def _by_month(summary: DataFrame, *names: str) -> DataFrame:
    return summary.filter(F.col("month_date").isNotNull()).groupBy("month_date").agg(*_sums(*names))


def current_month_kpis(summary: DataFrame, as_of: date | None = None) -> DataFrame:
    """Totals of the latest month; no row when there is no data.

    Months come partly from expected close dates, so the latest may lie in the future and hold pipeline only;
    ``as_of`` takes the latest month up to that day instead. All months are totalled in one pass and the latest row
    kept, which spares a second read of the summary to find its last month.
    """
    months = _by_month(summary, *KPIS)
    if as_of is not None:
        months = months.filter(F.col("month_date") <= F.lit(as_of))
    return months.orderBy(F.desc("month_date")).limit(1)


def current_month_kpi_labels(kpis: DataFrame) -> DataFrame:
    """The current month's totals as they stand on the cards."""
    return kpis.select("month_date", *[compact_dollars(F.col(k)).alias(k) for k in KPIS])


def monthly_trend(summary: DataFrame) -> DataFrame:
    names = ("total_invoiced", "total_recognized", "total_confirmed_orders")
    return _by_month(summary, *names).orderBy("month_date")


def pipeline_by_stage(deals: DataFrame) -> DataFrame:
    """Value and number of open deals by stage, in funnel order; stages outside the funnel come last.

    Needs no rep or customer: silver deals that are not won do as well as the gold table.
    """
    stages = deals.filter(F.col("stage").isNotNull()).groupBy("stage")
    totals = stages.agg(F.sum("deal_amount").alias("total"), F.count("deal_id").alias("count"))
    return totals.orderBy(position_in(F.col("stage"), S.OPEN_STAGES), "stage")


def revenue_by_category(categories: DataFrame) -> DataFrame:
    known = categories.filter(F.col("product_category").isNotNull())
    return known.groupBy("product_category").agg(*_sums("total_invoiced"))


def category_share(categories: DataFrame) -> DataFrame:
    """Each category's part of all invoiced revenue.

    The total is a scalar subquery over the same aggregate, so its exchange is reused and no window gathers the rows.
    """
    revenue = revenue_by_category(categories)
    total = revenue.agg(F.sum("total_invoiced")).scalar().cast("double")
    return revenue.withColumn("share", F.col("total_invoiced").cast("double") / F.nullif(total, F.lit(0.0)))
