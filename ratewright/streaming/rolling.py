"""Incremental forms of the batch operators: sliding totals, sessions, late corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_totals(stream: DataFrame, window_days: int, late: str = "14 days") -> DataFrame:
    """Totals of the last ``window_days`` days and today per entry, sliding by a day.

    A window that ends with day d holds ``window_days + 1`` days, as the batch frame does.
    """
    window = F.window("ts", f"{window_days + 1} days", "1 day")
    rows = stream.withWatermark("ts", late).groupBy("entry", window.alias("w"))
    return rows.agg(F.sum("cents").alias("total"), F.count("*").alias("n")).select("entry", F.to_date(F.date_sub(F.col("w.end").cast("date"), 1)).alias("date"), "total", "n")


def sessions(stream: DataFrame, gap_days: int, late: str = "14 days") -> DataFrame:
    """Runs of transactions of an entry without a pause longer than ``gap_days``."""
    pause = F.session_window("ts", f"{gap_days * 86400 + 1} seconds")  # a pause of the gap itself still joins
    rows = stream.withWatermark("ts", late).groupBy("entry", pause.alias("s"))
    return rows.agg(F.sum("cents").alias("total"), F.count("*").alias("n")).select("entry", F.col("s.start").alias("start"), "total", "n")


def without_repeats(stream: DataFrame, late: str = "14 days") -> DataFrame:
    """A transaction that comes in again within the watermark counts once."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["account", "imported_id"])


def tumbling(stream: DataFrame, unit: str = "1 day", late: str = "14 days") -> DataFrame:
    """Totals per entry and bucket."""
    rows = stream.withWatermark("ts", late).groupBy("entry", F.window("ts", unit).alias("w"))
    return rows.agg(F.sum("cents").alias("total"), F.count("*").alias("n")).select("entry", F.col("w.start").alias("start"), "total", "n")
