"""Writing results into stored tables: imports, assignments, snapshots, projections.

Each is one commit, so a reader sees all of it or nothing, and with ``batch`` a repeated
delivery changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright.operators import dedup
from ratewright.store import StoredTable

TRANSACTION = "id bigint, account bigint, date date, cents bigint, merchant string, imported_id string, settlement_status string"
BATCH = "batch bigint, imported bigint, skipped bigint, superseded bigint"
ASSIGNMENT = "entity bigint, transaction bigint, entry string, fit double"
PROJECTION = "entity bigint, date date, income bigint, spend bigint, margin bigint, balance bigint, pinch boolean"
#: Groups of accounts, and of entities, that are stored apart; what a commit costs at least grows with them.
BUCKETS = 16


def transactions_at(spark: SparkSession, path: str, buckets: int = BUCKETS) -> StoredTable:
    """Transactions by groups of accounts and by year, so that an import opens the accounts and years that it has."""
    return StoredTable(spark, path, TRANSACTION, ["id"], {"bucket": f"pmod(xxhash64(account), {buckets})", "year": "year(date)"})


def batches_at(spark: SparkSession, path: str) -> StoredTable:
    return StoredTable(spark, path, BATCH, ["batch"])


def assignments_at(spark: SparkSession, path: str) -> StoredTable:
    return StoredTable(spark, path, ASSIGNMENT, ["transaction", "entry"], {"entity": "entity"})


def projections_at(spark: SparkSession, path: str) -> StoredTable:
    return StoredTable(spark, path, PROJECTION, ["entity", "date"], {"bucket": f"pmod(xxhash64(entity), {BUCKETS})"})


def save_import(transactions: StoredTable, batches: StoredTable, candidates: DataFrame, actions: DataFrame, batch: int) -> int:
    """Superseded rows go, inserted and superseding candidates come in as flux, and the batch's counts are kept."""
    fresh = candidates.join(actions.filter("action <> 'skip'").select("row"), "row", "left_semi")
    rows = fresh.drop("id").withColumn("settlement_status", F.lit("flux")).withColumnRenamed("row", "id").select(transactions.schema.names)
    gone = actions.filter("action = 'supersede'").select(F.col("stored_id").alias("id"))
    old = transactions.read().select("id", "account", "date")  # so that the partitions of those to go are known
    version = transactions.commit(rows, old.join(gone, "id", "left_semi"), "import", batch)
    batches.commit(dedup.counts(actions).select(F.lit(batch).cast("bigint").alias("batch"), "imported", "skipped", "superseded"), writer="import", batch=batch)
    return version


def save_assignments(table: StoredTable, new: DataFrame, entities: DataFrame, batch: int | None = None) -> int:
    """All assignments of ``entities(entity)`` anew; of two for the same pair the better fit stays."""
    best = new.groupBy("entity", "transaction", "entry").agg(F.max("fit").alias("fit"))
    return table.commit(best, entities.select("entity"), None if batch is None else "match", batch)


def save_projections(table: StoredTable, new: DataFrame, entities: DataFrame, batch: int | None = None) -> int:
    """All projected days of ``entities(entity)`` anew."""
    return table.commit(new, entities.select("entity"), None if batch is None else "project", batch)
