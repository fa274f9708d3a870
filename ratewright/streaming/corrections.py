"""Late corrections in a stream: an upsert per batch that a repeated delivery does not change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ratewright.checkpoints import cut_lineage
from ratewright.operators import dedup, persist
from ratewright.store import StoredTable

#: What a stream of transactions has: ``row`` tells rows apart, a greater one is later.
ROW = "row bigint, account bigint, date date, cents bigint, merchant string, imported_id string"


def of_accounts(transactions: StoredTable, accounts: DataFrame) -> DataFrame:
    """Stored transactions of some accounts; only the groups of accounts that they are in are opened."""
    groups = {p[0] for p in transactions.partitions_of(accounts.select("account", F.lit("2000-01-01").cast("date").alias("date")))}
    parts = [p for p in transactions.manifest().folders if p[0] in groups]
    return transactions.read(only=parts).join(accounts.select("account").distinct(), "account", "left_semi")


def latest_of_batch(rows: DataFrame) -> DataFrame:
    """Of rows with the same account and imported id the last one; rows without an imported id all stay."""
    last = Window.partitionBy("account", "imported_id").orderBy(F.col("row").desc())
    named = rows.filter("imported_id is not null").withColumn("__k", F.row_number().over(last)).filter("__k = 1").drop("__k")
    return named.unionByName(rows.filter("imported_id is null"))


def correct(transactions: StoredTable, batches: StoredTable, rows: DataFrame, batch: int, days: int = 3, share: float = 0.005, settlement: int = 14) -> None:
    """Put a batch of new and corrected transactions into the stored ones, once.

    A row whose like is stored supersedes it while that is young, is skipped once it is settled
    or old, and comes in anew where there is none, as :func:`.dedup.classify` decides. A batch
    that was stored before changes nothing.
    """
    if batch <= min(t.manifest().batches.get("import", -1) for t in (transactions, batches)):
        return
    fresh = cut_lineage(latest_of_batch(rows.filter("row is not null and account is not null and date is not null and cents is not null")))
    stored = of_accounts(transactions, fresh.select("account"))
    actions = cut_lineage(dedup.classify(fresh, stored.select("id", "account", "date", "cents", "merchant", "imported_id", "settlement_status"), days, share, settlement))
    persist.save_import(transactions, batches, fresh, actions, batch)


def apply_corrections(stream: DataFrame, transactions: StoredTable, batches: StoredTable, checkpoint: str, settlement: int = 14) -> StreamingQuery:
    """Work off a stream of :data:`ROW`; a restart delivers the batch that broke off again, and it counts once."""

    def batch(rows: DataFrame, number: int) -> None:
        correct(transactions, batches, rows, number, settlement=settlement)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
