"""Cash-flow projection: which entries fire on which day ahead, and the running balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewright.functions.dates import anchor_kind, anchor_values, lapsed_on, resolve_dom

#: Days ahead; with today itself there is one row more. Days that a fire date covers.
HORIZON, COVERED = 90, 45


def covers(day: Column, due: Column, anchor: Column, period_days: Column) -> Column:
    """Whether an entry's rate counts on ``day``.

    Without a due date never; without an anchor for one period from the due date; by
    weekday; on days of month if one of them fell within the last 45 days; by interval
    from the due date on.
    """
    values, kind = anchor_values(anchor), anchor_kind(anchor)

    def fires(v: Column) -> Column:
        def in_month(k: Column) -> Column:
            first = F.add_months(F.trunc(day, "month"), k)
            fire = F.date_add(first, resolve_dom(v, first) - 1)
            return F.coalesce((fire <= day) & (F.date_diff(day, fire) <= COVERED), F.lit(False))

        return F.exists(F.sequence(F.lit(-2), F.lit(0)), in_month)

    one_period = (day >= due) & (day < F.date_add(due, period_days))
    test = F.when(anchor.isNull() | kind.isNull(), F.when(anchor.isNull(), one_period).otherwise(day >= due)).when(kind == "dow", F.weekday(day) == F.get(values, F.lit(0))).when(kind == "dom", F.exists(values, fires)).otherwise(day >= due)
    return F.coalesce(due.isNotNull() & test, F.lit(False))


def projected_rate(actual: Column, projected: Column) -> Column:
    """Whole cents of the latest actual rate, else of the projected one."""
    return F.floor(F.abs(F.coalesce(actual, projected)))


def project(entries: DataFrame, keys: list[str], start_balance: str = "balance", horizon: int = HORIZON) -> DataFrame:
    """A row per key and day ahead: income, spend, margin, running balance and whether it is a pinch point.

    ``entries``: ``direction, due, anchor, period_days, rate, as_of`` and the balance per
    key. Entries of both directions count nowhere. The balance of day 0 holds its margin.
    """
    ahead = entries.withColumn("date", F.explode(F.sequence(F.col("as_of"), F.date_add("as_of", horizon))))
    on = covers(F.col("date"), F.col("due"), F.col("anchor"), F.col("period_days"))
    amount = lambda d: F.sum(F.when(on & (F.col("direction") == d), F.col("rate")).otherwise(0))
    days = ahead.groupBy(*keys, "date").agg(amount("income").alias("income"), amount("spend").alias("spend"), F.max(start_balance).alias("start"))
    upto = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("margin", F.col("income") - F.col("spend"))
    balance = F.col("start") + F.sum("margin").over(upto)
    return days.select(*keys, "date", "income", "spend", "margin", balance.alias("balance"), (F.col("margin") < 0).alias("pinch"))


def ended(entries: DataFrame) -> DataFrame:
    """Live and pending entries that lapsed: they wait for review with an alert. ``entries`` hold ``due, last_date, as_of``."""
    end = lapsed_on(F.col("due"), F.col("last_date"), F.col("period_days"), F.col("as_of"))
    open_ = entries.filter("status in ('live', 'pending') and end_date is null").withColumn("ends", end)
    return open_.filter("ends is not null").withColumn("status", F.lit("pending")).withColumn("alert_type", F.lit("ended"))
