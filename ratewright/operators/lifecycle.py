"""Changes of small catalog tables: entries, labels, jobs, exports, accounts. Each returns the new table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright.checkpoints import cut_lineage

#: Entries that every entity has, with their priority.
SYSTEM_ENTRIES = [("All", "mixed"), ("Income", "income"), ("Spend", "spend")]
SYSTEM_PRIORITY = 9999
#: Kinds of jobs that write snapshots, and states of a job that is not over.
SNAPSHOT_JOBS, ACTIVE = ["import.process", "account.analyze", "entries.reprocess"], ["queued", "processing"]
#: Hours that an export is kept.
EXPORT_HOURS = 24


class SystemEntryError(ValueError):
    """System entries cannot be changed."""


def replace_assignments(old: DataFrame, new: DataFrame, entity: Column) -> DataFrame:
    """All assignments of an entity anew; of two for the same pair the better fit stays."""
    best = new.groupBy("entity", "transaction", "entry").agg(F.max("fit").alias("fit"))
    return old.filter(~entity).unionByName(best.select(old.columns))


def delete_with_balance(txns: DataFrame, gone: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transactions without those in ``gone(id)``, and accounts whose balances have lost their sums."""
    lost = txns.join(gone, "id", "left_semi").groupBy("account").agg(F.sum("cents").alias("lost"))
    rest = accounts.join(lost, "account", "left")
    return txns.join(gone, "id", "left_anti"), rest.withColumn("balance", F.col("balance") - F.coalesce("lost", F.lit(0))).drop("lost")


def review(entries: DataFrame, chosen: Column, approve: bool, day: Column) -> DataFrame:
    """Approve or reject entries under review.

    Approved: one with an ``ended`` alert ends on its own end or ``day``, another goes live. Rejected: ended.
    """
    ends = chosen & (F.col("alert_type") == "ended") if approve else F.lit(False)
    ends = F.coalesce(ends, F.lit(False))
    status = F.when(chosen, F.when(ends | F.lit(not approve), "ended").otherwise("live")).otherwise(F.col("status"))
    return (
        entries.withColumn("status", status)
        .withColumn("end_date", F.when(ends, F.coalesce("end_date", day)).otherwise(F.col("end_date")))
        .withColumn("alert_type", F.when(~chosen, F.col("alert_type")))
    )


def update_entry(entries: DataFrame, entry_id: str, **changes: Column) -> DataFrame:
    """Change columns of one entry; system entries refuse."""
    if entries.filter((F.col("id") == entry_id) & (F.col("source") == "system")).limit(1).count():
        raise SystemEntryError(entry_id)
    mine = F.col("id") == entry_id
    return entries.withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in changes.items()})


def set_status(entries: DataFrame, entry_id: str, active: bool) -> DataFrame:
    return update_entry(entries, entry_id, status=F.lit("live" if active else "pending"))


def end_entry(entries: DataFrame, entry_id: str, day: dt.date) -> DataFrame:
    return update_entry(entries, entry_id, status=F.lit("ended"), end_date=F.lit(day))


def drop_orphan_labels(labels: DataFrame, entries: DataFrame) -> DataFrame:
    """Labels without those that no entry names; system labels stay."""
    used = entries.select(F.col("label_id").alias("id")).distinct()
    system = labels.filter("source = 'system'")
    return labels.filter("source <> 'system'").join(used, "id", "left_semi").unionByName(system)


def seed_system_entries(spark: SparkSession, entries: DataFrame, entity: str, start: dt.date) -> DataFrame:
    """Entries with the system ones of an entity that are not there yet."""
    rows = [(f"{entity}:{name}", entity, name, direction, SYSTEM_PRIORITY, "live", "system", start) for name, direction in SYSTEM_ENTRIES]
    seed = spark.createDataFrame(rows, "id string, entity string, label_id string, direction string, priority int, status string, source string, start_date date")
    return entries.unionByName(seed.join(entries, "id", "left_anti"), allowMissingColumns=True)


def active_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs that wait or run."""
    return jobs.filter(F.col("status").isin(ACTIVE))


def active_snapshot_jobs(jobs: DataFrame) -> DataFrame:
    """``(job_id)`` of waiting and running jobs that write snapshots; reports leave out their rows."""
    return active_jobs(jobs).filter(F.col("job_type").isin(SNAPSHOT_JOBS)).select(F.col("id").alias("job_id"))


def changes(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """One JSON message per row of ``after`` that is new or differs from ``before``, as ``(key, payload)``.

    It is what listeners of a table are told; removed rows give none.
    """
    fresh = after.exceptAll(before.select(after.columns))
    return fresh.select(key, F.to_json(F.struct(*(F.col(c) for c in after.columns))).alias("payload"))


def label_cycle_nodes(edges: DataFrame) -> DataFrame:
    """``(entity, label)`` on or behind a cycle of ``edges(entity, label, input)``, for all entities at once.

    Labels without a pending input are taken away until none is left to take: those that stay
    have a way that never ends. There are as many rounds as the longest way that does, each
    checkpointed. Edges with a null are none.
    """
    left = cut_lineage(edges.select("entity", "label", "input").filter("label is not null and input is not null").distinct())
    size = left.count()
    while size:
        pending = left.select("entity", F.col("label").alias("input")).distinct()
        left = cut_lineage(left.join(pending, ["entity", "input"], "left_semi").select("entity", "label", "input"))
        before, size = size, left.count()
        if before == size:
            break
    return left.select("entity", "label").distinct()


def create_job(jobs: DataFrame, job: DataFrame) -> DataFrame:
    """Jobs with new ones, unless one of its kind waits or runs for the entity; of several new ones of a kind the first by id."""
    first = job.groupBy("entity_id", "job_type").agg(F.min("id").alias("id"))
    one = job.join(first, ["entity_id", "job_type", "id"], "left_semi").dropDuplicates(["entity_id", "job_type"])
    return jobs.unionByName(one.join(active_jobs(jobs), ["entity_id", "job_type"], "left_anti").select(jobs.columns))


def job_transition(jobs: DataFrame, job_id: str, status: str, now: Column, error: str | None = None) -> DataFrame:
    mine = F.col("id") == job_id
    started = F.when(mine & F.lit(status == "processing"), now).otherwise(F.col("started_at"))
    completed = F.when(mine & F.lit(status in ("complete", "failed")), now).otherwise(F.col("completed_at"))
    return jobs.withColumns({"status": F.when(mine, status).otherwise(F.col("status")), "started_at": started, "completed_at": completed, "error": F.when(mine, F.lit(error)).otherwise(F.col("error"))})


def purge_exports(exports: DataFrame, now: Column) -> DataFrame:
    return exports.filter(F.col("expires_at") >= now)


def recalculated_balances(accounts: DataFrame, txns: DataFrame) -> DataFrame:
    """Accounts with ``balance``: what they began with and all their transactions."""
    sums = txns.groupBy("account").agg(F.sum("cents").alias("moved"))
    return accounts.join(sums, "account", "left").withColumn("balance", F.col("starting") + F.coalesce("moved", F.lit(0))).drop("moved")


def settlement_window(accounts: DataFrame, mappings: DataFrame, default: int = 7) -> DataFrame:
    """One row: the longest settlement window of the institutions of active accounts."""
    used = accounts.filter("status = 'active'").join(mappings, "institution")
    return used.agg(F.coalesce(F.max("settlement_window_days"), F.lit(default)).alias("days"))
