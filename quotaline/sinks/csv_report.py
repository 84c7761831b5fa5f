"""CSV export."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quotaline.sinks import folders

# Quotes are doubled inside quoted text, and nulls and empty text are both written as nothing.
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "nullValue": "", "emptyValue": ""}


def export_csv(report: DataFrame, path: str) -> None:
    """Write a report as a folder of CSV files, each with a header, in the order of the report.

    An earlier report of that name stays until the new one is complete.
    """
    staged = folders.beside(path)
    report.write.options(**CSV_OPTIONS).csv(staged)
    folders.swap_in(report.sparkSession, staged, path)
