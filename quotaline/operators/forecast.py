"""Blended forecast by month, adjusted by the reps' feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotaline.functions.labels import compact_dollars, dollars, month_label, short_name
from quotaline.sources import schemas as S

SHEET_SIZE = 15
_MONTHLY = ("total_invoiced", "total_recognized", "total_weighted_pipeline", "blended_forecast")


def adjustment_sheet(
    deals: DataFrame, rep_id: str | None = None, rows: int = SHEET_SIZE, reps: DataFrame | None = None
) -> DataFrame:
    """The deals a rep may adjust: the first by close date, each starting at its forecast.

    ``deals`` hold the rep's name, or ``reps`` does: then it is looked up for the rows of the sheet only. For one rep this is a top-k. For all reps it ranks within each rep; the rank filter is applied on the map side as
    well, so a rep with very many deals sends at most ``rows`` of them per task.
    """
    by_close = [F.asc_nulls_last("expected_close_date"), F.asc("deal_id")]
    if rep_id is not None:
        first = deals.filter(F.col("rep_id") == rep_id).orderBy(*by_close).limit(rows)
    else:
        place = F.row_number().over(Window.partitionBy("rep_id").orderBy(*by_close))
        first = deals.filter(F.col("rep_id").isNotNull()).withColumn("place", place).filter(F.col("place") <= rows)
    if reps is not None:
        first = first.join(reps.select("rep_id", "rep_name"), "rep_id", "left")
    return first.select(
        "rep_id",
        "rep_name",
        "deal_id",
        short_name(F.col("deal_name")).alias("deal_name"),
        "stage",
        "expected_close_date",
        "deal_amount",
        compact_dollars(F.col("deal_amount")).alias("deal_amount_label"),
        F.col("forecasted_amount").alias("original_forecast"),
        F.col("forecasted_amount").alias("adjusted_forecast"),
    )


def feedback_submission(
    sheet: DataFrame,
    edits: DataFrame,
    confidence: str = "Medium",
    risks: str = "",
    upside: str = "",
    notes: str = "",
) -> DataFrame:
    """One submission per rep of the sheet: its deals, at the edited amounts (rep_id, deal_id, adjusted_forecast) where
    there are any and at their forecast otherwise, in the sheet's order.

    The rules of the form hold: an edit is of a line of the sheet, there is one per line, and its amount is a number
    not below zero; anything else is an error. The array holds one sheet, so its length is bounded by the sheet's.
    """
    amount = F.col("adjusted_forecast").cast(S.MONEY)
    changed = edits.groupBy("rep_id", "deal_id").agg(F.count("*").alias("times"), F.max(amount).alias("edited"))
    lines = sheet.withColumn("line", F.lit(True)).join(changed, ["rep_id", "deal_id"], "full")
    checked = (
        F.when(F.col("line").isNull(), F.raise_error(F.concat(F.lit("edit of a deal that is not in the sheet: "), F.coalesce("deal_id", F.lit("null")))))
        .when(F.col("times") > 1, F.raise_error(F.concat(F.lit("more than one edit of deal "), F.col("deal_id"))))
        .when(F.col("times").isNotNull() & F.coalesce(F.col("edited") < 0, F.lit(True)), F.raise_error(F.concat(F.lit("no amount, or one below zero, for deal "), F.col("deal_id"))))
        .otherwise(F.coalesce("edited", "adjusted_forecast"))
    )
    entry = F.struct(
        F.col("expected_close_date").isNull().alias("undated"),
        "expected_close_date",
        "deal_id",
        "original_forecast",
        checked.alias("adjusted_forecast"),
    )
    grouped = lines.groupBy("rep_id").agg(
        F.max("rep_name").alias("rep_name"), F.array_sort(F.collect_list(entry)).alias("lines")
    )
    return grouped.select(
        "rep_id",
        "rep_name",
        F.current_timestamp().alias("submitted_at"),
        *[F.lit(v).alias(n) for n, v in zip(("confidence", "risks", "upside", "notes"), (confidence, risks, upside, notes))],
        F.transform(
            "lines",
            lambda x: F.struct(*[x[c].alias(c) for c in ("deal_id", "original_forecast", "adjusted_forecast")]),
        ).alias("adjustments"),
    )


def newest_submission_per_rep(feedback: DataFrame) -> DataFrame:
    """Only the last submission of each rep (opt-in: by default every resubmission counts again)."""
    columns = feedback.columns
    rest = [c for c in columns if c not in {"rep_id", "submitted_at"}]
    newest = feedback.groupBy("rep_id").agg(F.max(F.struct("submitted_at", *rest)).alias("row"))
    return newest.select(*[F.col(c) if c == "rep_id" else F.col(f"row.{c}").alias(c) for c in columns])


def explode_adjustments(feedback: DataFrame) -> DataFrame:
    """One row per deal adjustment."""
    return feedback.select("rep_id", "rep_name", "submitted_at", F.inline("adjustments")).withColumn(
        "delta", F.col("adjusted_forecast") - F.col("original_forecast")
    )


def net_adjustment_total(feedback: DataFrame) -> DataFrame:
    """Sum of adjusted minus original over all submissions, zero when there are none."""
    total = F.sum(F.col("adjusted_forecast") - F.col("original_forecast"))
    lines = feedback.select(F.inline("adjustments"))
    return lines.agg(F.coalesce(total, F.lit(0).cast(S.MONEY)).alias("net_adjustment"))


def _by_month(summary: DataFrame) -> DataFrame:
    months = summary.filter(F.col("month_date").isNotNull()).groupBy("month_date")
    return months.agg(*[F.sum(m).alias(m) for m in _MONTHLY])


def monthly_forecast(summary: DataFrame) -> DataFrame:
    return _by_month(summary).orderBy("month_date")


def rep_adjusted_forecast(
    summary: DataFrame, feedback: DataFrame, override_pct: int = 0, latest_only: bool = False
) -> DataFrame:
    """The monthly forecast plus the net adjustment spread evenly over the months shown.

    ``override_pct`` scales the adjusted forecast by a manager's percentage and ``latest_only`` counts one submission
    per rep; both are off by default. The months are counted in a window over the monthly rows, one per calendar
    month, rather than by reading the summary again.
    """
    if latest_only:
        feedback = newest_submission_per_rep(feedback)
    net = net_adjustment_total(feedback).scalar()
    months = F.count("*").over(Window.partitionBy())
    adjusted = F.col("blended_forecast") + net / F.greatest(months, F.lit(1))
    if override_pct:
        adjusted = adjusted * F.lit(1 + override_pct / 100).cast(S.RATIO)
    return _by_month(summary).withColumn("rep_adjusted_forecast", adjusted).orderBy("month_date")


def forecast_totals(forecast: DataFrame) -> DataFrame:
    """Totals over all months, and how far the adjusted forecast is from the system's."""
    totals = forecast.agg(
        F.sum("total_invoiced").alias("total_invoiced"),
        F.sum("blended_forecast").alias("system_forecast"),
        F.sum("rep_adjusted_forecast").alias("rep_adjusted_forecast"),
    )
    return totals.withColumn("delta", F.col("rep_adjusted_forecast") - F.col("system_forecast"))


def forecast_total_labels(totals: DataFrame) -> DataFrame:
    return totals.select(*[compact_dollars(F.col(c)).alias(c) for c in totals.columns])


def forecast_display_table(forecast: DataFrame) -> DataFrame:
    """The forecast with month labels, whole-dollar amounts and display headers."""
    headers = {
        "total_invoiced": "Invoiced",
        "total_recognized": "Recognized",
        "total_weighted_pipeline": "Weighted Pipeline",
        "blended_forecast": "System Forecast",
        "rep_adjusted_forecast": "Rep Forecast",
    }
    return forecast.orderBy("month_date").select(
        month_label(F.col("month_date")).alias("Month"),
        *[dollars(F.col(c)).alias(header) for c, header in headers.items()],
    )
