"""Manager review of the submitted feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotaline.functions import labels
from quotaline.operators.forecast import explode_adjustments


def _net_adjustment() -> Column:
    """Sum over one submission's array, in place; an empty or missing array is zero, as is a delta without an amount."""
    zero = F.lit(0).cast("decimal(28,2)")
    deltas = F.transform("adjustments", lambda a: a["adjusted_forecast"] - a["original_forecast"])
    total = F.aggregate(deltas, zero, lambda acc, x: (acc + F.coalesce(x, zero)).cast("decimal(28,2)"))
    return F.coalesce(total, zero)


def feedback_review(feedback: DataFrame) -> DataFrame:
    """One row per submission as the manager sees it, newest first."""
    net = F.col("net_adjustment")
    seen = feedback.withColumn("net_adjustment", _net_adjustment())
    return seen.orderBy(F.desc_nulls_first("submitted_at"), "rep_id").select(
        "rep_id",
        "rep_name",
        labels.day_label(F.col("submitted_at")).alias("submitted_on"),
        labels.minute_label(F.col("submitted_at")).alias("submitted_stamp"),
        labels.confidence_icon(F.col("confidence")).alias("confidence_icon"),
        "confidence",
        "net_adjustment",
        labels.direction(net).alias("direction"),
        labels.compact_dollars(F.abs(net)).alias("net_adjustment_label"),
        *[labels.shown_text(F.col(c)).alias(c) for c in ("risks", "upside", "notes")],
    )


def nonzero_adjustments(feedback: DataFrame) -> DataFrame:
    """The deal adjustments that change a forecast."""
    return explode_adjustments(feedback).filter(F.col("delta") != 0)


def override_summary(overrides: DataFrame) -> DataFrame:
    """Stored overrides with the percentage as it is confirmed to the manager."""
    return overrides.select(
        "manager_override_pct",
        labels.signed_percent(F.col("manager_override_pct")).alias("override_label"),
        "manager_notes",
        "approved_at",
        "approved_by",
    )
