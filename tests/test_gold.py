"""Rollups and gold tables: unmatched rows, null keys, plans and hot keys."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quotaline import session
from quotaline.operators import gold, silver
from quotaline.operators.serving import monthly_summary
from quotaline.plans import catalog
from quotaline.sinks.clustered import clustered
from quotaline.sources.schemas import GOLD_LAYOUT
from tests.conftest import SMALL, day, dec, executed_plan


def summarize(frames, invoices=(), orders=(), deals=(), reps=()):
    return gold.gold_rep_monthly_summary(
        silver.silver_invoices(frames.invoices(*invoices)),
        silver.silver_orders(frames.orders(*orders)),
        silver.silver_deals(frames.deals(*deals)),
        silver.silver_sales_reps(frames.reps(*reps)),
    )


def test_facts_of_one_rep_and_month_meet(frames):
    rows = summarize(
        frames,
        invoices=[{"revenue_recognized_pct": 0.5}, {"invoice_id": "I2"}],
        orders=[{}, {"order_id": "O2", "ship_status": "In Transit"}, {"order_id": "O3", "is_confirmed": None}],
        deals=[{"expected_close_date": "2024-01-31"}, {"deal_id": "D2", "stage": "Closed Won"}],
        reps=[{"rep_id": "R1", "rep_name": "Ann"}],
    ).collect()
    (row,) = rows
    assert row.rep_name == "Ann" and row.month_date == day("2024-01-01")
    assert (row.total_invoiced, row.total_recognized, row.invoice_count) == (dec("200.00"), dec("150.00"), 2)
    assert (row.total_confirmed_orders, row.confirmed_order_count, row.shipped_revenue) == (dec("200"), 2, dec("100"))
    assert (row.total_pipeline_value, row.total_weighted_pipeline, row.active_deal_count) == (dec("100"), dec("50"), 1)
    assert row.blended_forecast == dec("250.00")


def test_unmatched_months_are_zero_filled_and_unknown_reps_stay(frames):
    rows = summarize(frames, invoices=[{}], orders=[{"order_date": "2024-03-01"}], deals=[{"rep_id": "R9"}])
    got = {(r.rep_id, str(r.month_date)): (r.total_invoiced, r.total_confirmed_orders, r.total_pipeline_value) for r in rows.collect()}
    assert got == {
        ("R1", "2024-01-01"): (dec("100"), 0, 0),
        ("R1", "2024-03-01"): (0, dec("100"), 0),
        ("R9", "2024-02-01"): (0, 0, dec("100")),
    }
    assert rows.filter("rep_name IS NOT NULL").count() == 0


def test_rows_without_rep_or_month_never_meet_across_facts(frames):
    rows = summarize(
        frames,
        invoices=[{"rep_id": None}, {"invoice_id": "I2", "rep_id": None}, {"invoice_id": "I3", "invoice_date": None}],
        orders=[{"rep_id": None}, {"order_id": "O2", "order_date": None}],
        deals=[{"rep_id": None, "expected_close_date": "2024-01-20"}],
    ).collect()
    assert len(rows) == 5
    without_rep = [r for r in rows if r.rep_id is None]
    assert sorted((r.invoice_count, r.confirmed_order_count, r.active_deal_count) for r in without_rep) == [
        (0, 0, 1), (0, 1, 0), (2, 0, 0),
    ]


def test_summary_equals_brute_force_over_random_rows(frames):
    dice = random.Random(7)
    reps, months = [None, "R1", "R2", "R3"], [None, "2024-01-05", "2024-01-28", "2024-02-01"]
    invoices = [
        {"invoice_id": f"I{i}", "rep_id": dice.choice(reps), "invoice_date": dice.choice(months), "invoice_amount": i + 0.25}
        for i in range(60)
    ]
    orders = [
        {"order_id": f"O{i}", "rep_id": dice.choice(reps), "order_date": dice.choice(months), "order_amount": i + 0.5,
         "is_confirmed": dice.choice([True, False, None])}
        for i in range(60)
    ]
    deals = [
        {"deal_id": f"D{i}", "rep_id": dice.choice(reps), "expected_close_date": dice.choice(months),
         "deal_amount": i + 1.0, "stage": dice.choice(["Discovery", "Closed Won"])}
        for i in range(60)
    ]
    expected = defaultdict(lambda: [0, 0, 0])

    def add(place, fact, rep, when, amount):
        month = when and when[:8] + "01"
        expected[(rep, month, fact if rep is None or month is None else "")][place] += dec(amount)

    for r in invoices:
        if r["invoice_amount"] > 0:
            add(0, "i", r["rep_id"], r["invoice_date"], r["invoice_amount"])
    for r in orders:
        if r["is_confirmed"] and r["order_amount"] > 0:
            add(1, "o", r["rep_id"], r["order_date"], r["order_amount"])
    for r in deals:
        if r["stage"] != "Closed Won":
            add(2, "d", r["rep_id"], r["expected_close_date"], r["deal_amount"])

    rows = summarize(frames, invoices, orders, deals).collect()
    got = sorted(
        (str(r.rep_id), str(r.month_date), r.total_invoiced, r.total_confirmed_orders, r.total_pipeline_value) for r in rows
    )
    assert got == sorted((str(rep), str(month), *totals) for (rep, month, _), totals in expected.items())


def test_summary_plan_has_no_fact_join_and_no_shuffle_above_the_rollups(frames):
    plan = executed_plan(summarize(frames, [{}], [{}], [{}], [{"rep_id": "R1", "rep_name": "A"}]))
    assert "FullOuter" not in plan and "Union" in plan
    shuffled = re.findall(r"Exchange hashpartitioning\((rep_id#\d+, month_date#\d+[^)]*)", plan)
    assert len(shuffled) == 3 and not any("unmatched" in keys for keys in shuffled)


def test_rep_filter_reaches_every_fact(frames, spark, tmp_path):
    makers = {"invoices": silver.silver_invoices, "orders": silver.silver_orders, "deals": silver.silver_deals}
    tables = {}
    for name, clean in makers.items():
        clean(getattr(frames, name)({})).write.parquet(str(tmp_path / name))
        tables[name] = spark.read.parquet(str(tmp_path / name))
    summary = gold.gold_rep_monthly_summary(*tables.values(), silver.silver_sales_reps(frames.reps()))
    plan = executed_plan(monthly_summary(summary, "R1"))
    assert plan.count("EqualTo(rep_id,R1)") == 3


def test_details_keep_facts_without_dimension(frames):
    rows = gold.gold_invoice_details(
        silver.silver_invoices(frames.invoices({}, {"invoice_id": "I2", "rep_id": None, "customer_id": "C9"})),
        silver.silver_sales_reps(frames.reps({"rep_id": "R1", "rep_name": "Ann"})),
        silver.silver_customers(frames.customers({"customer_id": "C1", "customer_name": "Acme", "tier": "SMB"})),
    )
    got = {r.invoice_id: (r.rep_name, r.rep_region, r.customer_name, r.customer_tier) for r in rows.collect()}
    assert got == {"I1": ("Ann", "EAST", "Acme", "SMB"), "I2": (None, None, None, None)}
    assert len(rows.columns) == 16


def test_active_deals_leave_out_won(frames):
    rows = gold.gold_active_deals(
        silver.silver_deals(frames.deals({}, {"deal_id": "D2", "stage": "Closed Won"})),
        silver.silver_sales_reps(frames.reps()),
        silver.silver_customers(frames.customers()),
    )
    assert [r.deal_id for r in rows.collect()] == ["D1"] and len(rows.columns) == 18


def test_category_summary_keeps_null_groups_and_averages(frames):
    rows = gold.gold_category_summary(silver.silver_invoices(frames.invoices(
        {"invoice_amount": 1.0}, {"invoice_amount": 2.0}, {"invoice_amount": 2.0}, {"product_category": None}
    )))
    got = {r.product_category: (r.total_invoiced, r.invoice_count, r.avg_invoice_amount) for r in rows.collect()}
    assert got == {"Networking": (dec("5"), 3, dec("1.666667")), None: (dec("100"), 1, dec("100"))}


@pytest.fixture
def shuffled(spark):
    """Shuffle every join and split partitions from small sizes on."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16kb",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16kb",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1kb",
    }
    for key, value in changed.items():
        spark.conf.set(key, value)
    yield
    for key in changed:
        spark.conf.unset(key)


def test_hot_rep_and_missing_rep_are_split_in_lookups(spark, frames, shuffled):
    n = 30_000
    invoices = spark.range(0, n, 1, 16).select(
        F.concat(F.lit("I"), "id").alias("invoice_id"),
        F.when(F.col("id") % 5 < 2, "C0").otherwise(F.concat(F.lit("C"), F.col("id") % 500)).alias("customer_id"),
        F.when(F.col("id") % 3 == 0, "R0").when(F.col("id") % 3 == 1, F.concat(F.lit("R"), F.col("id") % 97)).alias("rep_id"),
        F.lit("2024-01-01").alias("invoice_date"), F.lit(1.0).alias("invoice_amount"), F.lit("Shipped").alias("status"),
        F.lit(1.0).alias("revenue_recognized_pct"), F.lit("N").alias("product_category"),
        F.sha2(F.col("id").cast("string"), 256).alias("po_number"), F.lit("Net 30").alias("payment_terms"),
    )
    reps = frames.reps(*[{"rep_id": f"R{i}", "rep_name": f"N{i}"} for i in range(97)])
    customers = frames.customers(*[{"customer_id": f"C{i}", "customer_name": f"N{i}"} for i in range(500)])
    details = gold.gold_invoice_details(
        silver.silver_invoices(invoices), silver.silver_sales_reps(reps), silver.silver_customers(customers)
    )
    plan = executed_plan(details)
    assert plan.count("SortMergeJoin(skew=true)") == 2  # the hot rep and the hot customer
    written = executed_plan(clustered(details, GOLD_LAYOUT["gold_invoice_details"]))
    assert "SortMergeJoin(skew=true)" in written and "REBALANCE" in written
    rows = details.agg(F.count("*").alias("n"), F.countDistinct("invoice_id").alias("ids"), F.count("rep_name").alias("named")).first()
    assert (rows.n, rows.ids, rows.named) == (n, n, 20_000)


def test_even_keys_get_enough_partitions(spark, frames, shuffled):
    n = session.initial_partitions(500 << 40)
    assert (n, session.initial_partitions(0, 8), session.initial_partitions(100 << 30)) == (session.MOST, 8, 400)
    rows = spark.range(0, 20_000, 1, 8).select((F.col("id") % 5000).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))

    def largest() -> int:
        joined = rows.join(rows.groupBy("k").count(), "k")
        return max(joined.select("v").rdd.mapPartitions(lambda rows: [sum(len(r[0]) for r in rows)]).collect())

    advisory = 16 << 10
    assert largest() > 4 * advisory  # even keys in the session's own eight partitions
    with session.sized_for(spark, 256 * session.PARTITION_BYTES) as wanted:
        assert wanted == 256 and largest() <= 1.5 * advisory
    assert spark.conf.get(session.INITIAL, None) is None


def test_reads_that_need_no_customer_scan_none(spark):
    lake = catalog.Lake(spark, SMALL)
    for name in ("deals_by_stage", "deals_by_stage_rep", "report_row_count", "net_adjustment_total", "adjustment_sheet", "feedback_review", "nonzero_adjustments"):
        plan = catalog._QUERIES[name](lake)._jdf.queryExecution().optimizedPlan().toString()
        assert "c_custkey" not in plan, name
