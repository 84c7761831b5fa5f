"""Downloadable reports."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaline.functions.labels import report_file_name
from quotaline.operators import serving
from quotaline.sinks.csv_report import export_csv

# The report types, which also name the files.
MONTHLY = "Monthly Sales Summary"
DEALS = "Deal Pipeline Report"
INVOICES = "Invoice Detail Report"
FORECAST = "Forecast vs Actuals"

# Per report type: the read it shows, the gold table it reads and the day its rows belong to.
_REPORTS = {
    MONTHLY: (serving.monthly_summary, "gold_rep_monthly_summary", "month_date"),
    DEALS: (serving.active_deals, "gold_active_deals", "expected_close_date"),
    INVOICES: (serving.invoice_details, "gold_invoice_details", "invoice_date"),
    FORECAST: (serving.monthly_summary, "gold_rep_monthly_summary", "month_date"),
}


def report(
    gold: Mapping[str, DataFrame],
    report_type: str,
    rep_id: str | None = None,
    region: str | None = None,
    start: date | None = None,
    end: date | None = None,
    rows: int | None = None,
) -> DataFrame:
    """The rows of a report, all of them unless ``rows`` limits it. ``start`` and ``end`` restrict it by day; by
    default all days are reported."""
    read, table, day = _REPORTS[report_type]
    source = gold[table]
    if start is not None:
        source = source.filter(F.col(day) >= F.lit(start))
    if end is not None:
        source = source.filter(F.col(day) <= F.lit(end))
    if report_type == INVOICES:
        return read(source, rep_id, region, rows)
    found = read(source, rep_id, region)
    return found if rows is None else found.limit(rows)


def report_row_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"))


def write_report(rows: DataFrame, folder: str, report_type: str, on: date, prefix: str = "sales") -> str:
    """Export a report under its dated name; returns the path."""
    path = f"{folder}/{report_file_name(report_type, on, prefix)}"
    export_csv(rows, path)
    return path
