"""Text labels against Python's own formatting."""

from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from quotaline.functions import labels

AMOUNTS = [
    "0", "0.5", "1.5", "2.5", "999.49", "999.5", "999.99", "1000", "1499.99", "1500", "2500", "2500.5", "12345.67",
    "999499.99", "999500", "999999.99", "1000000", "1250000", "1350000", "1149999.99", "1150000", "123456789.01",
    "-0.4", "-1500", "-1234567.5", "98765432109876.55",
]


def compact(value: Decimal) -> str:
    if value >= 1_000_000:
        return f"${value / 1_000_000:,.1f}M"
    if value >= 1_000:
        return f"${value / 1_000:,.0f}K"
    return f"${value:,.0f}"


def test_currency_equals_python_formatting(spark):
    rows = spark.createDataFrame([(Decimal(a),) for a in AMOUNTS], "amount decimal(28,2)")
    got = rows.select("amount", labels.compact_dollars(F.col("amount")), labels.dollars(F.col("amount"))).collect()
    for amount, short, whole in got:
        assert short == compact(amount)
        assert whole == f"${amount:,.0f}"


def test_quotients_are_rounded_once(spark):
    value = F.lit("463.4999").cast("decimal(38,10)")
    assert spark.range(1).select(labels.dollars(value)).first()[0] == "$463"


def test_other_labels(spark):
    one = spark.range(1)
    moment = F.lit("2024-03-05 09:07:59").cast("timestamp")
    row = one.select(
        labels.month_label(moment), labels.day_label(moment), labels.minute_label(moment),
        labels.direction(F.lit(0)), labels.direction(F.lit(-1)), labels.short_name(F.lit("x" * 70)),
        labels.shown_text(F.lit("")), labels.shown_text(F.lit("a")),
        labels.confidence_icon(F.lit(None).cast("string")),
    ).first()
    assert tuple(row) == (
        "Mar 2024", "2024-03-05", "2024-03-05T09:07", "↑", "↓", "x" * 50, None, "a", "⚪",
    )
    signs = one.select(*[labels.signed_percent(F.lit(p)) for p in (5, -30, 0)]).first()
    assert tuple(signs) == ("+5%", "-30%", "+0%")


def test_report_file_name():
    assert labels.report_file_name("Deal Pipeline Report", date(2024, 3, 5), "acme") == "acme_deal_pipeline_report_20240305.csv"
