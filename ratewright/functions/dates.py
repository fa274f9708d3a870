"""Calendar days: parsing, recurrence anchors, due dates and fire dates."""

from __future__ import annotations

import base64
import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The date formats of statement files, in the order they are tried. Years have four digits or two, never fewer.
FORMATS = ["yyyy-MM-dd", "M/d/yyyy", "M/d/yy", "d-MMM-yyyy", "MMMM d, yyyy"]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
#: Days by which a date may miss its anchor; and days after the due date before an entry has lapsed.
ANCHOR_TOLERANCE, LAPSE_TOLERANCE = 5, 5


def parse_date(text: Column) -> Column:
    """The first format that fits; null if none does."""
    trimmed = F.trim(text)
    return F.coalesce(*(F.try_to_date(trimmed, f) for f in FORMATS))


def days_in_month(day: Column) -> Column:
    return F.dayofmonth(F.last_day(day))


def normalize_dom(day: Column) -> Column:
    """Day of month, days past the 28th counted from the end (-1 is the last)."""
    dom = F.dayofmonth(day)
    return F.when(dom > 28, dom - days_in_month(day) - 1).otherwise(dom)


def resolve_dom(anchor: Column, day: Column) -> Column:
    """The day of ``day``'s month that an anchor day names; null where the month has none."""
    dim = days_in_month(day)
    return F.when((anchor > 0) & (anchor <= dim), anchor).when((anchor < 0) & (dim + anchor + 1 >= 1), dim + anchor + 1)


def next_dow_after(weekday: Column, day: Column) -> Column:
    """The next such weekday (Monday 0) strictly after ``day``."""
    return F.date_add(day, 1 + F.pmod(weekday - F.weekday(F.date_add(day, 1)), F.lit(7)))


def anchor_kind(anchor: Column) -> Column:
    """``dom``, ``dow`` or ``interval``; null for anything else."""
    return (
        F.when(anchor.rlike(r"\Adom:-?[0-9]+(,-?[0-9]+)*\z"), "dom").when(anchor.rlike(r"\Adow:[0-6]\z"), "dow").when(anchor.rlike(r"\Ainterval:[0-9]+\z"), "interval")
    )


def anchor_values(anchor: Column) -> Column:
    """The numbers of an anchor; null where it has no kind."""
    numbers = F.split(F.substring_index(anchor, ":", -1), ",").cast("array<int>")
    return F.when(anchor_kind(anchor).isNotNull(), numbers)


def _dom_dates(values: Column, day: Column, months: Column) -> Column:
    """Dates that the anchor days name in the months ``months`` away from ``day``'s month."""

    def of_month(k: Column) -> Column:
        first = F.add_months(F.trunc(day, "month"), k)
        return F.transform(values, lambda v: F.date_add(first, resolve_dom(v, first) - 1))

    return F.array_compact(F.flatten(F.transform(months, of_month)))


def next_dom_after(values: Column, day: Column) -> Column:
    """The first date strictly after ``day`` that an anchor day names, within 25 months."""
    return F.array_min(F.filter(_dom_dates(values, day, F.sequence(F.lit(0), F.lit(24))), lambda d: d > day))


def next_due_date(anchor: Column, period_days: Column, last: Column) -> Column:
    """When the next one is due after ``last``; null without one."""
    values, kind = anchor_values(anchor), anchor_kind(anchor)
    return F.when(
        last.isNotNull(),
        F.when(kind == "dow", next_dow_after(F.get(values, F.lit(0)), last)).when(kind == "dom", next_dom_after(values, last)).when(kind == "interval", F.date_add(last, F.get(values, F.lit(0)))).otherwise(F.date_add(last, period_days)),
    )


def lapsed_on(due: Column, last: Column, period_days: Column, as_of: Column) -> Column:
    """End date of an entry that is overdue beyond the tolerance, else null."""
    end = F.coalesce(due, F.date_add(last, period_days))
    return F.when(as_of > F.date_add(end, LAPSE_TOLERANCE), end)


def dom_fires(rows: DataFrame, values: str, first: str, last: str) -> DataFrame:
    """``rows`` by their fire dates (``fire``) from ``first`` to ``last``, each date once."""
    months = F.sequence(F.lit(0), F.months_between(F.trunc(last, "month"), F.trunc(first, "month")).cast("int"))
    dates = F.array_distinct(F.filter(_dom_dates(F.col(values), F.col(first), months), lambda d: (d >= F.col(first)) & (d <= F.col(last))))
    return rows.withColumn("fire", F.explode(F.array_sort(dates)))


def settlement_status(day: Column, anchor: Column, window: Column) -> Column:
    return F.when(day < F.date_sub(anchor, window), "settled").otherwise("flux")


def effective_status(status: Column, day: Column, anchor: Column, window: Column) -> Column:
    """A stored status with flux rows told apart by age."""
    return F.when(status == "settled", "settled").when(day < F.date_sub(anchor, window), "aged_flux").otherwise("young_flux")


# --- plan-time helpers on single values ---


def anchor_of_cadence(cadence: str) -> str:
    """``monthly:15`` to ``dom:15``, ``weekly:friday`` to ``dow:4`` and so on; ValueError for anything else."""
    kind, _, rest = cadence.partition(":")
    if kind == "monthly" and (rest == "last" or re.fullmatch(r"-?[0-9]+", rest)):
        return "dom:-1" if rest == "last" else f"dom:{int(rest)}"
    if kind == "semimonthly" and re.fullmatch(r"-?[0-9]+,-?[0-9]+", rest):
        return f"dom:{rest}"
    if kind == "weekly" and rest in WEEKDAYS:
        return f"dow:{WEEKDAYS.index(rest)}"
    if kind == "every" and re.fullmatch(r"[0-9]+", rest):
        return f"interval:{int(rest)}"
    raise ValueError(f"no cadence: {cadence!r}")


def cadence_of_anchor(anchor: str) -> str:
    """What :func:`anchor_of_cadence` turns into ``anchor``."""
    kind, _, rest = anchor.partition(":")
    if kind == "dom":
        return ("semimonthly:" if "," in rest else "monthly:") + ("last" if rest == "-1" else rest)
    if kind == "dow":
        return f"weekly:{WEEKDAYS[int(rest)]}"
    if kind == "interval":
        return f"every:{rest}"
    raise ValueError(f"no anchor: {anchor!r}")


def add_calendar(day: dt.date, years: int = 0, months: int = 0, days: int = 0) -> dt.date:
    """``day`` and a calendar distance; a day past the month's end runs into the next month."""
    month = day.month - 1 + months + 12 * years
    first = dt.date(day.year + month // 12, month % 12 + 1, 1)
    return first + dt.timedelta(days=day.day - 1 + days)


def resolve_range(latest: dt.date, start: dt.date | None = None, end: dt.date | None = None, span: tuple[int, int, int] | None = None) -> tuple[dt.date | None, dt.date | None]:
    """First and last day of a report: given days win, a span of (years, months, days) fills in the missing one."""
    if span is None or (start and end):
        return start, end
    if start:
        return start, add_calendar(start, *span)
    end = end or latest
    return add_calendar(end, *(-x for x in span)), end


def encode_cursor(*parts: object) -> str:
    return base64.b64encode(",".join(map(str, parts)).encode()).decode()


def decode_cursor(cursor: str) -> tuple[str, str]:
    """The two parts of a cursor, cut at the last comma."""
    left, _, right = base64.b64decode(cursor).decode().rpartition(",")
    return left, right
