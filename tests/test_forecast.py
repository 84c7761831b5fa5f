"""Dashboard, forecast and review."""

from datetime import date

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quotaline.operators import dashboard, forecast, gold, profile, review, silver
from tests.conftest import day, dec, executed_plan, moment

JAN, FEB, MAR = day("2024-01-01"), day("2024-02-01"), day("2024-03-01")


def months(frames):
    return frames.summary(
        {"rep_id": "R1", "month_date": JAN, "total_invoiced": 10, "total_recognized": 5, "blended_forecast": 10},
        {"rep_id": "R2", "month_date": JAN, "total_invoiced": 1, "blended_forecast": 1},
        {"rep_id": "R1", "month_date": MAR, "total_pipeline_value": 9, "total_weighted_pipeline": 4, "blended_forecast": 4},
        {"rep_id": "R1", "month_date": None, "total_invoiced": 99, "blended_forecast": 99},
    )


def submissions(frames):
    return frames.feedback(
        {"rep_id": "R1", "submitted_at": moment("2024-01-01T08:30"), "adjustments": [("D1", 10, 12), ("D2", 5, 5)]},
        {"rep_id": "R1", "submitted_at": moment("2024-01-02T09:45"), "adjustments": [("D1", 10, "13.5")]},
        {"rep_id": "R2", "submitted_at": moment("2024-01-03"), "adjustments": [("D3", 8, 7)]},
        {"rep_id": "R3", "submitted_at": moment("2024-01-04"), "adjustments": []},
    )


def test_latest_month_may_hold_pipeline_only(frames):
    row = dashboard.current_month_kpis(months(frames)).first()
    assert (row.month_date, row.total_invoiced, row.total_weighted_pipeline) == (MAR, 0, dec("4"))
    row = dashboard.current_month_kpis(months(frames), as_of=date(2024, 2, 15)).first()
    assert (row.month_date, row.total_invoiced) == (JAN, dec("11"))


def test_no_data_gives_no_kpis(frames):
    assert dashboard.current_month_kpis(frames.summary({"rep_id": "R1"})).count() == 0


def test_trend_skips_rows_without_month(frames):
    rows = dashboard.monthly_trend(months(frames)).collect()
    assert [(r.month_date, r.total_invoiced) for r in rows] == [(JAN, dec("11")), (MAR, 0)]


def test_stages_come_in_funnel_order_and_unknown_last(frames):
    stages = ["Parked", "Verbal Commit", "Prospecting", "Negotiation", "Discovery", "Proposal Sent"]
    rows = silver.silver_deals(frames.deals(*[{"deal_id": s, "stage": s} for s in stages])).select("deal_id", "stage", "deal_amount")
    got = [r.stage for r in dashboard.pipeline_by_stage(rows).collect()]
    assert got == ["Prospecting", "Discovery", "Proposal Sent", "Negotiation", "Verbal Commit", "Parked"]


def test_category_shares_add_up_and_reuse_the_aggregate(frames):
    invoices = [{"product_category": "X"}, {"product_category": "Y", "invoice_amount": 300.0}, {"product_category": None}]
    categories = gold.gold_category_summary(silver.silver_invoices(frames.invoices(*invoices)))
    shares = dashboard.category_share(categories)
    assert {r.product_category: r.share for r in shares.collect()} == {"X": 0.25, "Y": 0.75}
    plan = executed_plan(shares)
    assert "ReusedExchange" in plan and "Window" not in plan and "NestedLoop" not in plan


def test_sheet_takes_the_first_deals_by_close_date(spark, frames, tmp_path):
    deals = [
        {"deal_id": f"D{i:03}", "rep_id": rep, "expected_close_date": f"2024-02-{1 + i % 28:02}", "deal_name": "n" * 60}
        for rep in ("R1", "R2")
        for i in range(40)
    ]
    rows = gold.gold_active_deals(
        silver.silver_deals(frames.deals(*deals, {"deal_id": "X", "rep_id": None})),
        silver.silver_sales_reps(frames.reps()),
        silver.silver_customers(frames.customers()),
    )
    rows.write.parquet(str(tmp_path / "deals"))
    rows = spark.read.parquet(str(tmp_path / "deals"))
    every = forecast.adjustment_sheet(rows)
    one = forecast.adjustment_sheet(rows, "R1")
    expected = sorted((f"2024-02-{1 + i % 28:02}", f"D{i:03}") for i in range(40))[:15]
    assert [(str(r.expected_close_date), r.deal_id) for r in one.collect()] == expected
    assert sorted((str(r.expected_close_date), r.deal_id) for r in every.collect() if r.rep_id == "R1") == expected
    assert every.count() == 30 and one.first().deal_name == "n" * 50
    assert executed_plan(every).count("WindowGroupLimit") == 2  # once before the shuffle


def test_submission_takes_the_edits_over_the_forecast(frames):
    rows = gold.gold_active_deals(
        silver.silver_deals(frames.deals({"deal_id": "b"}, {"deal_id": "a"}, {"deal_id": "first", "expected_close_date": "2024-01-02"})),
        silver.silver_sales_reps(frames.reps({"rep_id": "R1", "rep_name": "Ann"})),
        silver.silver_customers(frames.customers()),
    )
    sheet = forecast.adjustment_sheet(rows, "R1")

    def submitted(*edits):
        made = frames.spark.createDataFrame(list(edits), "rep_id string, deal_id string, adjusted_forecast double")
        return forecast.feedback_submission(sheet, made, risks="late").collect()

    (row,) = submitted(("R1", "a", 75.5))
    assert (row.rep_id, row.rep_name, row.confidence, row.risks) == ("R1", "Ann", "Medium", "late")
    assert [tuple(a) for a in row.adjustments] == [
        ("first", dec("50"), dec("50")), ("a", dec("50"), dec("75.5")), ("b", dec("50"), dec("50")),
    ]
    wrong = {
        "not in the sheet": [("R2", "b", 1.0)], "more than one edit": [("R1", "a", 1.0), ("R1", "a", 2.0)],
        "below zero": [("R1", "a", -1.0)], "no amount": [("R1", "b", None)],
    }
    for message, edits in wrong.items():
        with pytest.raises(PySparkException, match=message):
            submitted(*edits)


def test_submission_keeps_the_order_of_the_sheet(frames):
    deals = [{"deal_id": "undated", "expected_close_date": None}, {"deal_id": "late", "expected_close_date": "2024-03-01"}, {"deal_id": "early"}]
    sheet = forecast.adjustment_sheet(
        gold.open_deals(silver.silver_deals(frames.deals(*deals))), "R1",
        reps=silver.silver_sales_reps(frames.reps({"rep_id": "R1", "rep_name": "Ann"})),
    )
    assert [r.deal_id for r in sheet.orderBy(F.asc_nulls_last("expected_close_date")).collect()] == ["early", "late", "undated"]
    none = frames.spark.createDataFrame([], "rep_id string, deal_id string, adjusted_forecast double")
    (row,) = forecast.feedback_submission(sheet, none).collect()
    assert (row.rep_name, [a.deal_id for a in row.adjustments]) == ("Ann", ["early", "late", "undated"])


def test_review_and_total_agree_on_missing_amounts(frames):
    rows = frames.feedback({"rep_id": "R1", "submitted_at": moment("2024-01-01"), "adjustments": [("D1", 10, None), ("D2", 5, 9)]})
    assert review.feedback_review(rows).first().net_adjustment == dec("4.00")
    assert forecast.net_adjustment_total(rows).first().net_adjustment == dec("4.00")


def test_every_resubmission_counts_unless_latest_only(frames):
    rows = submissions(frames)
    assert forecast.net_adjustment_total(rows).first().net_adjustment == dec("4.50")
    latest = forecast.newest_submission_per_rep(rows)
    assert forecast.net_adjustment_total(latest).first().net_adjustment == dec("2.50")
    assert latest.count() == 3 and latest.columns == rows.columns


def test_adjustment_is_spread_over_the_months(frames):
    rows = forecast.rep_adjusted_forecast(months(frames), submissions(frames)).collect()
    assert [(r.month_date, r.rep_adjusted_forecast) for r in rows] == [(JAN, dec("13.25")), (MAR, dec("6.25"))]


def test_override_scales_the_adjusted_forecast(frames):
    rows = forecast.rep_adjusted_forecast(months(frames), submissions(frames), override_pct=-10).collect()
    assert [float(r.rep_adjusted_forecast) for r in rows] == [11.925, 5.625]


def test_no_feedback_leaves_the_forecast(frames):
    nothing = submissions(frames).filter("rep_id = 'none'")
    assert forecast.net_adjustment_total(nothing).first().net_adjustment == 0
    rows = forecast.rep_adjusted_forecast(months(frames), nothing)
    assert [r.rep_adjusted_forecast for r in rows.collect()] == [dec("11"), dec("4")]
    totals = forecast.forecast_totals(rows).first()
    assert (totals.total_invoiced, totals.system_forecast, totals.delta) == (dec("11"), dec("15"), 0)


def test_display_table(frames):
    table = forecast.forecast_display_table(forecast.rep_adjusted_forecast(months(frames), submissions(frames)))
    assert table.columns == ["Month", "Invoiced", "Recognized", "Weighted Pipeline", "System Forecast", "Rep Forecast"]
    assert tuple(table.first()) == ("Jan 2024", "$11", "$5", "$0", "$11", "$13")


def test_review_of_submissions(frames):
    rows = frames.feedback(
        {"rep_id": "R1", "rep_name": "Ann", "submitted_at": moment("2024-01-02T09:45:59"), "confidence": "High",
         "risks": "", "upside": "more", "adjustments": [("D1", 10, 1510)]},
        {"rep_id": "R2", "submitted_at": moment("2024-01-03T00:00"), "confidence": "Unsure", "adjustments": [("D1", 10, 4)]},
        {"rep_id": "R3", "submitted_at": moment("2024-01-01T00:00"), "adjustments": []},
    )
    second, first, third = review.feedback_review(rows).collect()
    assert (first.confidence_icon, first.direction, first.net_adjustment_label) == ("🟢", "↑", "$2K")
    assert (first.submitted_on, first.submitted_stamp) == ("2024-01-02", "2024-01-02T09:45")
    assert (first.risks, first.upside, first.notes) == (None, "more", None)
    assert (second.confidence_icon, second.direction, second.net_adjustment_label) == ("⚪", "↓", "$6")
    assert (third.confidence_icon, third.direction, third.net_adjustment) == ("⚪", "↑", 0)


def test_unchanged_deals_are_left_out(frames):
    rows = review.nonzero_adjustments(submissions(frames)).collect()
    assert sorted((r.deal_id, r.delta) for r in rows) == [("D1", dec("2")), ("D1", dec("3.5")), ("D3", dec("-1"))]
    assert forecast.explode_adjustments(submissions(frames)).count() == 4


def test_raw_profile(frames):
    raw = {
        "sales_reps": frames.reps({"rep_id": "R1"}, {"rep_id": "R2", "region": None}),
        "customers": frames.customers({"tier": "SMB"}),
        "invoices": frames.invoices({"status": "Cancelled"}, {"invoice_amount": -5.0, "revenue_recognized_pct": 0.5}),
        "orders": frames.orders({}, {"ship_status": "Delivered"}, {}),
        "deals": frames.deals({}, {"stage": None, "deal_amount": 7.0}, {"stage": "Closed Won"}, {"stage": "Closed Lost"}),
    }
    assert {r.entity: r.n for r in profile.profile_counts(raw).collect()} == {
        "sales_reps": 2, "customers": 1, "invoices": 2, "orders": 3, "deals": 4,
    }
    values = profile.profile_values(raw)
    assert [(r.value, r.n) for r in values.collect() if r.entity == "orders"] == [("Shipped", 2), ("Delivered", 1)]
    assert values.filter("value IS NULL").count() == 0
    assert profile.raw_total_invoiced(raw["invoices"]).first()[0] == 95.0
    assert profile.raw_total_recognized(raw["invoices"]).first()[0] == 97.5
    assert profile.raw_total_pipeline(raw["deals"]).first()[0] == 107.0


def test_months_are_counted_in_one_small_window(frames):
    plan = executed_plan(forecast.rep_adjusted_forecast(months(frames), submissions(frames)))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
