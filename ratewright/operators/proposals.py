"""The catalogue of entries: proposals kept from run to run, lapsed ones ended, interrupted ones split.

Ids follow from content, so a run that is repeated, or finds the same again, changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.functions.dates import lapsed_on, next_due_date
from ratewright.operators import cluster

#: Columns of an entry; ``part_of`` is the entry that an earlier part was split from.
ENTRY = (
    "entity bigint, entry string, label string, direction string, entry_type string, rate_method string, period_days int, rate double, status string, conditions string, anchor string, "
    "start_date date, end_date date, next_due_date date, alert_type string, fitness double, source string, part_of string, matched bigint"
)
COLUMNS = [c.split()[0] for c in ENTRY.split(", ")]


def content_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", *(p.cast("string") for p in parts)).cast("binary"), 256), 1, 16)


def keep(known: DataFrame, found: DataFrame, as_of: Column) -> DataFrame:
    """The entries that proposals add or change, as rows of :data:`ENTRY`.

    ``found`` is what :func:`.cluster.propose` gives by ``entity``. A pending entry of the engine
    with the same label takes the new facts and keeps its id; else there is a new one. One
    that has lapsed by ``as_of`` ends and says so. Entries of people, and those that went
    live or ended, are left alone.
    """
    pending = known.filter("source = 'engine' and status = 'pending' and part_of is null").groupBy("entity", "label").agg(F.min("entry").alias("old"))
    rows = found.withColumnRenamed("cluster", "label").join(pending, ["entity", "label"], "left")
    due = next_due_date(F.col("anchor"), F.col("period_days"), F.col("last_date"))
    rows = rows.withColumn("next_due_date", due).withColumn("end_date", lapsed_on(F.col("next_due_date"), F.col("last_date"), F.col("period_days"), as_of))
    own = {
        "entry": F.coalesce("old", content_id(F.col("entity"), F.col("label"), F.col("start_date"))), "anchor": F.when(F.col("entry_type") == "standing", F.col("anchor")),
        "rate_method": F.lit("median"), "rate": F.col("projected_rate_per_day"), "status": F.lit("pending"), "source": F.lit("engine"), "part_of": F.lit(None).cast("string"),
        "alert_type": F.when(F.col("end_date").isNotNull(), "ended").otherwise("new"), "matched": F.col("n"),
    }
    settled = known.filter("not (source = 'engine' and status = 'pending')").select("entry")
    return rows.withColumns(own).select(COLUMNS).join(settled, "entry", "left_anti").select(COLUMNS)


def unbacked(known: DataFrame, assigned: DataFrame) -> DataFrame:
    """``(entry)``: pending entries of the engine that no transaction is assigned to."""
    return known.filter("source = 'engine' and status = 'pending'").join(assigned.select("entry"), "entry", "left_anti").select("entry")


def pulled_back(entries: DataFrame, assigned: DataFrame) -> DataFrame:
    """Entries that start on their first assigned day, where that is before their start; ``assigned(entry, date)``."""
    first = assigned.groupBy("entry").agg(F.min("date").alias("first"))
    return entries.join(first, "entry", "left").withColumn("start_date", F.least("start_date", "first")).select(entries.columns)


def split(entries: DataFrame, assigned: DataFrame, slack: int = 5) -> tuple[DataFrame, DataFrame]:
    """Entries cut where no transaction came for longer than their period and ``slack`` days, and the assignments of all parts.

    ``assigned(entry, id, date, ...)``. The last part stays the entry and starts later; each part
    before it is a pending entry of its own with its first and last day. System entries,
    and those without a period, are not cut.
    """
    cut = entries.filter("source <> 'system' and period_days is not null and part_of is null").select("entry", "period_days")
    dated = assigned.join(cut, "entry").select("entry", "id", "date", "period_days")
    chunks = cluster.gap_chunks(dated, "entry", F.col("period_days"), slack)
    last = chunks.groupBy("entry").agg(F.max("chunk").alias("last"), F.max_by("start_date", "chunk").alias("last_start"))
    parts = chunks.join(last, "entry").filter("chunk < last").select("entry", F.col("start_date").alias("from"), F.col("end_date").alias("to"), "n")
    parts = parts.withColumn("part", content_id(F.col("entry"), F.col("from")))
    whole = entries.filter("part_of is null").join(last.filter("last > 0"), "entry", "left").withColumn("start_date", F.coalesce("last_start", "start_date")).select(entries.columns)
    earlier = {"part_of": F.col("entry"), "entry": F.col("part"), "start_date": F.col("from"), "end_date": F.col("to"), "status": F.lit("pending"), "source": F.lit("engine"), "rate_method": F.lit("median"), "alert_type": F.lit("ended"), "matched": F.col("n")}
    rows = whole.unionByName(entries.join(parts, "entry").withColumns(earlier).select(entries.columns))
    of_part = parts.select(F.col("entry").alias("__of"), F.col("part").alias("__part"), F.col("from").alias("__from"), F.col("to").alias("__to"))
    there = assigned.join(of_part, (F.col("entry") == F.col("__of")) & F.col("date").between(F.col("__from"), F.col("__to")), "left")
    return rows, there.withColumn("entry", F.coalesce("__part", "entry")).select(assigned.columns)
