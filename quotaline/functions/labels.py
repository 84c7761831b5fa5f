"""Text labels: currency, months, signs, ordered categories and file names."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# Amounts are rounded once, from this type. Cents alone would round quotients twice; dividing it by a million
# still loses no digit.
_EXACT = "decimal(28,8)"

# The icon shown for each confidence level, and for any other.
CONFIDENCE_ICONS = {"Very Low": "🔴", "Low": "🟠", "Medium": "🟡", "High": "🟢", "Very High": "🟣"}
OTHER_ICON = "⚪"


def dollars(amount: Column) -> Column:
    """Whole dollars with thousands separators, half-even: ``$1,234``."""
    return F.concat(F.lit("$"), F.format_number(amount.cast(_EXACT), 0))


def compact_dollars(amount: Column) -> Column:
    """``$1.2M`` from a million, ``$12K`` from a thousand, else whole dollars. Negatives are never shortened."""
    exact = amount.cast(_EXACT)
    millions = F.format_number(exact / F.lit(1_000_000), 1)
    thousands = F.format_number(exact / F.lit(1_000), 0)
    return (
        F.when(exact >= 1_000_000, F.concat(F.lit("$"), millions, F.lit("M")))
        .when(exact >= 1_000, F.concat(F.lit("$"), thousands, F.lit("K")))
        .otherwise(dollars(amount))
    )


def month_label(month: Column) -> Column:
    """``Mar 2024``."""
    return F.date_format(month, "MMM yyyy")


def day_label(moment: Column) -> Column:
    """``2024-03-05``."""
    return F.date_format(moment, "yyyy-MM-dd")


def minute_label(moment: Column) -> Column:
    """``2024-03-05T09:30``."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm")


def short_name(name: Column, length: int = 50) -> Column:
    return F.substring(name, 1, length)


def direction(change: Column) -> Column:
    """Arrow for the sign of a change; zero points up."""
    return F.when(change >= 0, "↑").otherwise("↓")


def signed_percent(percent: Column) -> Column:
    """``+5%``, ``-3%``, ``+0%``."""
    return F.format_string("%+d%%", percent)


def position_in(value: Column, ordered: Sequence[str]) -> Column:
    """1-based place of a value in an ordered category list; unknown and null values come last."""
    place = F.array_position(F.array(*[F.lit(v) for v in ordered]), value)
    return F.coalesce(F.nullif(place, F.lit(0)), F.lit(len(ordered) + 1)).cast("int")


def confidence_icon(level: Column) -> Column:
    icons = F.create_map(*[F.lit(x) for pair in CONFIDENCE_ICONS.items() for x in pair])
    return F.coalesce(F.try_element_at(icons, level), F.lit(OTHER_ICON))


def shown_text(text: Column) -> Column:
    """Free text, or null where there is nothing to show."""
    return F.nullif(text, F.lit(""))


def report_file_name(report_type: str, on: date, prefix: str = "sales") -> str:
    """``sales_monthly_sales_summary_20240305.csv``."""
    return f"{prefix}_{report_type.lower().replace(' ', '_')}_{on:%Y%m%d}.csv"
