"""Signed rates in cents per day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days that a report's month and year count.
DAYS = {"day": 1.0, "month": 30.44, "year": 365.0}


def sign_of(direction: Column) -> Column:
    return F.when(direction == "spend", -1).otherwise(1)


def window_days(day: Column, earliest: Column, window: Column | int) -> Column:
    """Days that a rolling total is divided by: since the first transaction, between 1 and the window."""
    window = F.lit(window) if isinstance(window, int) else window
    return F.when(earliest.isNull(), window).otherwise(F.least(F.greatest(F.date_diff(day, earliest), F.lit(1)), window))


def actual_rate(total: Column, days: Column) -> Column:
    return F.when(days == 0, F.lit(0.0)).otherwise(total / F.nullif(days, F.lit(0)))


def drift(actual: Column, projected: Column) -> Column:
    """How much better than projected; rates are signed, so more is always better."""
    return actual - projected


def in_dollars(rate: Column, granularity: str) -> Column:
    return rate / 100 * DAYS[granularity]


def spend_percent(spend: Column, income: Column) -> Column:
    """Whole percent of the income that is spent, 0 to 100."""
    share = F.when(income > 0, F.floor(F.abs(spend) / F.nullif(income, F.lit(0)) * 100)).otherwise(0)
    return F.least(F.greatest(share, F.lit(0)), F.lit(100)).cast("bigint")


def currency(cents: Column) -> Column:
    """``-$1,234.50`` and the like."""
    return F.concat(F.when(cents < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(cents) / 100, 2))
