"""Typing of raw text and double columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotaline.sources import schemas as S


def day(column: str, strict: bool = True) -> Column:
    """ISO text to a date. Invalid text raises, or becomes null when ``strict`` is off."""
    source = F.col(column)
    return (source.cast("date") if strict else source.try_cast("date")).alias(column)


def money(column: str) -> Column:
    return F.col(column).cast(S.MONEY).alias(column)


def ratio(column: str) -> Column:
    return F.col(column).cast(S.RATIO).alias(column)


def month_of(column: str) -> Column:
    """First day of the month, as a date, so it does not depend on the session time zone."""
    return F.trunc(F.col(column), "MM")


def or_zero(column: str) -> Column:
    """The column with nulls as zero, in its own type."""
    return F.coalesce(F.col(column), F.lit(0)).alias(column)
