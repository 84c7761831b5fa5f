"""Monthly rollups, enriched detail tables and the category summary.

Dimension lookups are plain left joins. Whether a dimension is small enough to broadcast is the planner's decision
from its measured size; beyond that the join shuffles, and adaptive execution splits the partition of a hot key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotaline.functions.typed import month_of, or_zero
from quotaline.session import in_ranges, is_broadcast
from quotaline.sources import schemas as S

INVOICE_MEASURES = ("total_invoiced", "total_recognized", "invoice_count")
ORDER_MEASURES = ("total_confirmed_orders", "confirmed_order_count", "shipped_revenue")
DEAL_MEASURES = ("total_pipeline_value", "total_weighted_pipeline", "active_deal_count")
CATEGORY_MEASURES = INVOICE_MEASURES


def _invoice_facts(invoices: DataFrame, *others: str) -> DataFrame:
    return invoices.select(
        "rep_id",
        *others,
        month_of("invoice_date").alias("month_date"),
        F.col("invoice_amount").alias("total_invoiced"),
        F.col("recognized_revenue").alias("total_recognized"),
        F.lit(1).alias("invoice_count"),
    )


def _order_facts(orders: DataFrame) -> DataFrame:
    shipped = F.col("ship_status").isin(*S.SHIPPED_STATUSES)
    return orders.filter(F.col("is_confirmed")).select(
        "rep_id",
        month_of("order_date").alias("month_date"),
        F.col("order_amount").alias("total_confirmed_orders"),
        F.lit(1).alias("confirmed_order_count"),
        F.when(shipped, F.col("order_amount")).otherwise(F.lit(0).cast(S.MONEY)).alias("shipped_revenue"),
    )


def open_deals(deals: DataFrame) -> DataFrame:
    """Deals that are not won, without their rep and customer."""
    return deals.filter(F.col("stage") != S.STAGE_WON)


def _deal_facts(deals: DataFrame) -> DataFrame:
    return open_deals(deals).select(
        "rep_id",
        month_of("expected_close_date").alias("month_date"),
        F.col("deal_amount").alias("total_pipeline_value"),
        F.col("forecasted_amount").alias("total_weighted_pipeline"),
        F.lit(1).alias("active_deal_count"),
    )


def _measure(name: str) -> Column:
    return (F.count(name) if name.endswith("_count") else F.sum(name)).alias(name)


def _by_rep_month(facts: DataFrame, measures: tuple[str, ...]) -> DataFrame:
    return facts.groupBy("rep_id", "month_date").agg(*[_measure(m) for m in measures])


def invoice_month_rollup(invoices: DataFrame) -> DataFrame:
    """Invoiced and recognized revenue by rep and invoice month."""
    return _by_rep_month(_invoice_facts(invoices), INVOICE_MEASURES)


def order_month_rollup(orders: DataFrame) -> DataFrame:
    """Confirmed orders, and the shipped part of them, by rep and order month."""
    return _by_rep_month(_order_facts(orders), ORDER_MEASURES)


def deal_month_rollup(deals: DataFrame) -> DataFrame:
    """Open deals by rep and month of expected close."""
    return _by_rep_month(_deal_facts(deals), DEAL_MEASURES)


def gold_rep_monthly_summary(
    invoices: DataFrame, orders: DataFrame, deals: DataFrame, reps: DataFrame
) -> DataFrame:
    """Invoices, confirmed orders and open pipeline side by side, one row per rep and month seen in any of them.

    The only shuffles are of the rollups' partial sums; no facts are joined.
    """
    return summary_of_rollups(invoice_month_rollup(invoices), order_month_rollup(orders), deal_month_rollup(deals), reps)


def summary_of_rollups(invoices: DataFrame, orders: DataFrame, deals: DataFrame, reps: DataFrame) -> DataFrame:
    """The summary from the three rollups by rep and month.

    The rollups are stacked and grouped once more. The stack keeps their common partitioning, and a rep filter on the
    result reaches all three inputs. A row without rep or month belongs to no common group: it is kept apart by the
    name of its fact, as an outer join would leave it unmatched.
    """
    rollups = {"invoices": invoices, "orders": orders, "deals": deals}
    keyless = F.col("rep_id").isNull() | F.col("month_date").isNull()
    stacked = reduce(
        lambda above, below: above.unionByName(below, allowMissingColumns=True),
        [df.withColumn("unmatched", F.when(keyless, F.lit(fact))) for fact, df in rollups.items()],
    )
    measures = INVOICE_MEASURES + ORDER_MEASURES + DEAL_MEASURES
    monthly = (
        stacked.groupBy("rep_id", "month_date", "unmatched")
        .agg(*[F.max(m).alias(m) for m in measures])  # each group has one row per fact, so at most one value
        .select("rep_id", "month_date", *[or_zero(m) for m in measures])
    )
    who = reps.select("rep_id", "rep_name", "region", "role", "annual_quota")
    return monthly.join(who, "rep_id", "left").select(
        "rep_id", "rep_name", "region", "role", "annual_quota", "month_date", *measures,
        (F.col("total_invoiced") + F.col("total_weighted_pipeline")).alias("blended_forecast"),
    )


def _with_rep_and_customer(facts: DataFrame, reps: DataFrame, customers: DataFrame, order: Sequence[Column | str] = ()) -> DataFrame:
    """Facts with their rep and customer.

    With ``order`` (columns of the result by name, or expressions on facts), rows are dealt to ranges of it before the
    lookups that are broadcast and that it does not name, so narrower rows are shuffled. A sort by ``order`` that
    follows finds the ranges and shuffles nothing; where no lookup can wait, it shuffles the whole rows as ever.
    """
    who = reps.select("rep_id", "rep_name", F.col("region").alias("rep_region"))
    whom = customers.select(
        "customer_id",
        "customer_name",
        F.col("vertical").alias("customer_vertical"),
        F.col("tier").alias("customer_tier"),
    )
    # Customers first: they are many, and a join that shuffles the facts then finds them without their reps' columns.
    lookups = [("customer_id", whom), ("rep_id", who)]
    named = {c for c in order if isinstance(c, str)}
    late = [(key, side) for key, side in lookups if order and is_broadcast(side) and not ({*side.columns} - {key}) & named]
    rows = facts
    for key, side in lookups:
        if key not in dict(late):
            rows = rows.join(side, key, "left")
    if late:
        rows = in_ranges(rows, order)
    for key, side in late:
        rows = rows.join(side, key, "left")
    return rows


_CONTEXT = ("rep_id", "rep_name", "rep_region", "customer_id", "customer_name", "customer_vertical", "customer_tier")


def gold_active_deals(deals: DataFrame, reps: DataFrame, customers: DataFrame, order: Sequence[Column | str] = ()) -> DataFrame:
    """Deals that are not won, with their rep and customer. ``order`` is one that they are sorted by afterwards."""
    return _with_rep_and_customer(open_deals(deals), reps, customers, order).select(
        "deal_id", "deal_name", *_CONTEXT, "stage", "deal_amount", "forecasted_amount", "probability",
        "product_category", "created_date", "expected_close_date", "deal_type", "next_step",
    )


def gold_invoice_details(invoices: DataFrame, reps: DataFrame, customers: DataFrame, order: Sequence[Column | str] = ()) -> DataFrame:
    """Invoices with their rep and customer. ``order`` is one that they are sorted by afterwards."""
    return _with_rep_and_customer(invoices, reps, customers, order).select(
        "invoice_id", *_CONTEXT, "invoice_date", "invoice_amount", "status", "revenue_recognized_pct",
        "recognized_revenue", "product_category", "po_number", "payment_terms",
    )


def category_rollup(invoices: DataFrame) -> DataFrame:
    """Sums and counts by month and product category."""
    by_month = invoices.groupBy(month_of("invoice_date").alias("month_date"), "product_category")
    return by_month.agg(
        F.sum("invoice_amount").alias("total_invoiced"),
        F.sum("recognized_revenue").alias("total_recognized"),
        F.count("*").alias("invoice_count"),
    )


def invoice_rollups(invoices: DataFrame) -> DataFrame:
    """The rollups of invoices in one pass over them, stacked; ``rollup_of`` takes them apart."""
    keys = ("rep_id", "month_date", "product_category")
    rows = _invoice_facts(invoices, "product_category")
    sets = rows.groupingSets([["rep_id", "month_date"], ["month_date", "product_category"]], *keys)
    return sets.agg(*[_measure(m) for m in INVOICE_MEASURES], F.grouping_id().alias("left_out"))


def rollup_of(stacked: DataFrame, name: str) -> DataFrame:
    """One of the stacked rollups: ``invoices`` or ``categories``. What it leaves out is a bit for each key, the last lowest."""
    keys, measures, _ = ROLLUPS[name]
    return stacked.where(F.col("left_out") == {"invoices": 0b001, "categories": 0b100}[name]).select(*keys, *measures)


def category_summary_of_rollup(rollup: DataFrame) -> DataFrame:
    """The category summary from its sums and counts; the average has the digits that ``avg`` gives money."""
    average = (F.col("total_invoiced") / F.col("invoice_count")).cast("decimal(22,6)")
    return rollup.withColumn("avg_invoice_amount", average)


def gold_category_summary(invoices: DataFrame) -> DataFrame:
    """Revenue by month and product category."""
    return category_summary_of_rollup(category_rollup(invoices))


#: The rollups that can be kept as states: their keys, their measures, and how they are made of new facts.
ROLLUPS = {
    "invoices": (("rep_id", "month_date"), INVOICE_MEASURES, invoice_month_rollup),
    "orders": (("rep_id", "month_date"), ORDER_MEASURES, order_month_rollup),
    "deals": (("rep_id", "month_date"), DEAL_MEASURES, deal_month_rollup),
    "categories": (("month_date", "product_category"), CATEGORY_MEASURES, category_rollup),
}


def merged(states: list[DataFrame], name: str) -> DataFrame:
    """States of disjoint facts put together: the rollup of all their facts, types included.

    Sums and counts add up, so facts that came later need none of the facts before them.
    """
    keys, measures, _ = ROLLUPS[name]
    kinds = dict(states[0].dtypes)
    stacked = reduce(DataFrame.unionByName, states)
    return stacked.groupBy(*keys).agg(*[F.sum(m).cast(kinds[m]).alias(m) for m in measures]).select(*states[0].columns)
