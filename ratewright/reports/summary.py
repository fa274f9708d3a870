"""Day summaries, time buckets, budget stacks and report files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.functions.rates import in_dollars


def _sum(value: str, direction: str) -> Column:
    return F.round(F.sum(F.when(F.col("direction") == direction, F.col(value)).otherwise(0.0)), 4)


def day_summary(rates: DataFrame, *keys: str) -> DataFrame:
    """Income, spend, margin and drift per key and day; rates are signed, so the margin is a sum."""
    out = rates.groupBy(*keys, "date").agg(_sum("actual", "income").alias("income"), _sum("actual", "spend").alias("spend"), F.round(F.sum("drift"), 4).alias("drift"))
    return out.select(*keys, "date", "income", "spend", F.round(F.col("income") + F.col("spend"), 4).alias("margin"), "drift")


def latest_summary(rates: DataFrame, *keys: str) -> DataFrame:
    """The day summary of the last day that has any snapshot."""
    last = rates.agg(F.max("date").alias("date"))
    return day_summary(rates.join(F.broadcast(last), "date"), *keys)


def without_active_jobs(rows: DataFrame, active: DataFrame) -> DataFrame:
    """Rows that no running job has written."""
    return rows.join(active.select("job_id"), "job_id", "left_anti")


def buckets(rates: DataFrame, unit: str, strict: bool = True) -> DataFrame:
    """Open, high, low, close and mean of the actual rate per entry and bucket.

    ``strict=False`` names the highest rate open and the lowest close.
    """
    start = F.trunc("date", unit)
    first, last = (F.min_by("actual", "date"), F.max_by("actual", "date")) if strict else (F.max("actual"), F.min("actual"))
    return rates.groupBy("entry", start.alias("bucket")).agg(
        first.alias("open"), F.max("actual").alias("high"), F.min("actual").alias("low"), last.alias("close"), F.round(F.avg("actual"), 4).alias("mean")
    )


def latest_per_entry(rates: DataFrame, upto: Column | None = None) -> DataFrame:
    """The last snapshot of each entry, or the last one not after ``upto``; combined before the shuffle."""
    rows = rates if upto is None else rates.filter(F.col("date") <= upto)
    top = F.max_by(F.struct("date", "actual", "projected", "drift"), "date").alias("s")
    return rows.groupBy("entry").agg(top).select("entry", "s.*")


def budget_stack(entries: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Rates by label at a day: sums, numbers of entries, drift and share of the income. Entries without a label stand together."""
    rows = entries.join(snapshot, "entry", "left").withColumn("rate", F.coalesce("actual", "projected", F.lit(0.0)))
    out = rows.groupBy("label").agg(F.round(F.sum("rate"), 4).alias("rate"), F.count("*").alias("entries"), F.round(F.sum(F.coalesce("drift", F.lit(0.0))), 4).alias("drift"))
    return out.withColumn("label", F.coalesce("label", F.lit("__null__")))


def report(summary: DataFrame, granularity: str) -> DataFrame:
    """Report rows in dollars per day, month or year with two places, as text."""
    unit = {"day": "day", "month": "mo", "year": "yr"}[granularity]
    columns = [F.format_string("%.2f", F.round(in_dollars(F.col(c), granularity), 2)).alias(f"{c.capitalize()}/{unit}") for c in ("income", "spend", "margin", "drift")]
    return summary.select(F.date_format("date", "yyyy-MM-dd").alias("Date"), *columns)


def write_report(rows: DataFrame, path: str) -> None:
    """One CSV file, by date; a report has a row a day."""
    rows.repartition(1).sortWithinPartitions("Date").write.mode("overwrite").csv(path, header=True)


def report_name(first: str | None, last: str | None) -> str:
    """File name by which ends of the range are given."""
    if first and last:
        return f"report_{first}_to_{last}.csv"
    if first:
        return f"report_from_{first}.csv"
    return f"report_to_{last}.csv" if last else "report_all.csv"
