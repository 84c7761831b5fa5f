"""Parameterised reads: filters, order, limits and the region's categories."""

import json

from pyspark.sql import functions as F

from quotaline.operators import gold, serving, silver
from quotaline.sources import schemas as S
from tests.conftest import day, dec, executed_plan, moment


def test_filter_of_empty_values_is_none(spark):
    assert serving.build_filter() is None
    assert serving.build_filter("", "All") is None
    assert serving.build_filter(None, "") is None


def test_filters_combine(frames):
    rows = frames.summary(
        {"rep_id": "R1", "region": "EAST"}, {"rep_id": "R1", "region": "WEST"}, {"rep_id": "R2", "region": "EAST"},
        {"rep_id": "R1", "region": None},
    )
    assert rows.filter(serving.build_filter("R1", "EAST", "region")).count() == 1
    assert rows.filter(serving.build_filter("R1")).count() == 3
    assert rows.filter(serving.build_filter(region="EAST", region_column="region")).count() == 2


def test_monthly_summary_orders_nulls_last(frames):
    rows = serving.monthly_summary(frames.summary(
        {"rep_id": "R2", "month_date": None}, {"rep_id": "R2", "month_date": day("2024-02-01")},
        {"rep_id": "R1", "month_date": day("2024-02-01")}, {"rep_id": "R9", "month_date": day("2024-01-01")},
    ))
    assert [r.rep_id for r in rows.collect()] == ["R9", "R1", "R2", "R2"]
    assert len(rows.columns) == 12


def details(frames, *invoices, reps=()):
    return gold.gold_invoice_details(
        silver.silver_invoices(frames.invoices(*invoices)),
        silver.silver_sales_reps(frames.reps(*reps)),
        silver.silver_customers(frames.customers()),
    )


def test_invoice_details_newest_first_with_ties_by_id(frames):
    rows = details(
        frames, {"invoice_id": "b"}, {"invoice_id": "a"}, {"invoice_id": "new", "invoice_date": "2024-05-01"},
        {"invoice_id": "undated", "invoice_date": None}, {"invoice_id": "old", "invoice_date": "2020-01-01"},
    )
    assert [r.invoice_id for r in serving.invoice_details(rows, rows=4).collect()] == ["undated", "new", "a", "b"]
    assert "TakeOrderedAndProject" in executed_plan(serving.invoice_details(rows))


def test_region_categories_keep_company_totals(frames):
    reps = [{"rep_id": "R1", "rep_name": "A", "region": "EAST"}, {"rep_id": "R2", "rep_name": "B", "region": "WEST"}]
    invoices = [
        {"invoice_id": "1", "rep_id": "R1", "product_category": "X"},
        {"invoice_id": "2", "rep_id": "R2", "product_category": "X", "invoice_amount": 900.0},
        {"invoice_id": "3", "rep_id": "R2", "product_category": "Y"},
        {"invoice_id": "4", "rep_id": None, "product_category": "Z"},
    ]
    categories = gold.gold_category_summary(silver.silver_invoices(frames.invoices(*invoices)))
    rows = details(frames, *invoices, reps=reps)
    east = serving.category_summary(categories, rows, "EAST")
    assert [(r.product_category, r.total_invoiced) for r in east.collect()] == [("X", dec("1000"))]
    within = serving.category_summary_within(rows, "EAST")
    assert [(r.product_category, r.total_invoiced) for r in within.collect()] == [("X", dec("100"))]
    assert serving.category_summary(categories, rows, "All").count() == 3


def test_region_categories_are_distinct_before_the_semi_join(frames):
    invoices = [{"invoice_id": str(i), "product_category": f"P{i % 3}"} for i in range(30)]
    rows = details(frames, *invoices, reps=[{"rep_id": "R1", "rep_name": "A"}])
    categories = gold.gold_category_summary(silver.silver_invoices(frames.invoices(*invoices)))
    plan = executed_plan(serving.category_summary(categories, rows, "EAST"))
    assert "LeftSemi" in plan
    joined = plan.split("LeftSemi", 1)[1]
    right = joined.rsplit("HashAggregate(keys=[product_category", 1)
    assert len(right) == 2  # aggregated below the join, on its right side


def test_rep_list_and_selectors(frames):
    rows = frames.summary(
        {"rep_id": "R2", "rep_name": "Zed", "region": "WEST"}, {"rep_id": "R2", "rep_name": "Zed", "region": "WEST"},
        {"rep_id": "R1", "rep_name": "Ann", "region": "EAST"}, {"rep_id": "R3", "rep_name": "Ann", "region": "EAST"},
        {"rep_id": "R4"},
    )
    assert [r.rep_id for r in serving.list_sales_reps(rows).collect()] == ["R1", "R3", "R2", "R4"]
    assert [r.region for r in serving.list_regions(rows).collect()] == ["All", "EAST", "WEST"]
    assert [tuple(r) for r in serving.rep_name_lookup(rows).collect()] == [("Ann", "R3"), ("Zed", "R2")]


def test_feedback_newest_first_and_json_decoded(frames):
    rows = frames.feedback(
        {"rep_id": "R1", "submitted_at": moment("2024-01-01"), "adjustments": [("D1", 1, 2)]},
        {"rep_id": "R1", "submitted_at": moment("2024-03-01"), "adjustments": []},
        {"rep_id": "R2", "submitted_at": None, "adjustments": [("D2", 1, 2)]},
    )
    stored = rows.withColumn("adjustments", F.to_json("adjustments"))
    back = serving.read_feedback(stored)
    assert back.schema["adjustments"].dataType == S.ADJUSTMENTS
    assert [str(r.submitted_at)[:7] for r in back.collect()] == ["None", "2024-03", "2024-01"]
    assert back.collect()[2].adjustments[0].adjusted_forecast == dec("2.00")
    assert serving.read_feedback(stored, "R1").count() == 2
    text = stored.filter("rep_id = 'R2'").first().adjustments
    assert json.loads(text) == [{"deal_id": "D2", "original_forecast": 1.0, "adjusted_forecast": 2.0}]
