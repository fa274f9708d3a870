"""The job chain on stored tables: import, match, detect, rate, project.

A batch of messages is worked off as one set of plans over all its entities; jobs of one
entity come one after the other. Each table is committed once per batch, and rates follow
from the difference between what is assigned and what is counted, so a batch that broke off
is delivered again and ends in the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ratewright.checkpoints import cut_lineage
from ratewright.functions.conditions import MATCHED
from ratewright.functions.dates import next_due_date
from ratewright.operators import cluster, crawl, match, persist, projection, proposals
from ratewright.operators import rates as R
from ratewright.reports.summary import latest_per_entry
from ratewright.settings import Settings
from ratewright.sources import folder
from ratewright.store import StoredTable
from ratewright.streaming import corrections, jobs

#: Numbers that a batch has for the jobs of one entity.
ROUNDS = 1 << 20
#: Kinds of jobs, and those that begin with a statement file.
IMPORTS, RATES = ["import.process"], ["import.process", "entries.reprocess", "account.analyze", "balance.project"]


class Engine:
    """Stored tables below ``path`` and the jobs that keep them; ``accounts(account, entity, balance)`` and the files' ``mappings`` are given."""

    def __init__(self, spark: SparkSession, path: str, accounts: DataFrame, mappings: DataFrame, settings: Settings | None = None, buckets: int = persist.BUCKETS):
        self.spark, self.path, self.accounts, self.mappings = spark, path, accounts, mappings
        self.settings = settings or Settings()
        self.transactions = persist.transactions_at(spark, f"{path}/transactions", buckets)
        self.batches = persist.batches_at(spark, f"{path}/batches")
        self.entries = StoredTable(spark, f"{path}/entries", proposals.ENTRY, ["entry"], {"entity": "entity"})
        self.assignments = persist.assignments_at(spark, f"{path}/assignments")
        self.snapshots = crawl.SnapshotStore.at(spark, f"{path}/rates", buckets)
        self.projections = persist.projections_at(spark, f"{path}/projections")
        self.log = StoredTable(spark, f"{path}/jobs", "job_id string, entity bigint, job_type string, status string, error string", ["job_id"])

    # --- jobs ---

    def handle(self, messages: DataFrame, number: int) -> None:
        """Work off a batch of parsed messages (:func:`.jobs.parse_messages`); a job id that is done is not done again."""
        text = F.concat_ws(": ", F.lit("bad message"), F.substring("raw", 1, 200))
        bad = messages.filter("not ok").select(F.coalesce("job_id", F.sha2("raw", 256)).alias("job_id"), F.lit(None).cast("bigint").alias("entity"), "job_type", F.lit("failed").alias("status"), text.alias("error"))
        done = self.log.read().select("job_id")
        todo = messages.filter("ok").dropDuplicates(["job_id"]).withColumn("entity", F.col("entity_id").try_cast("bigint")).join(done, "job_id", "left_anti")
        nth = F.row_number().over(Window.partitionBy("entity").orderBy("job_id"))
        todo = cut_lineage(todo.withColumn("nth", nth))
        most = todo.agg(F.max("nth")).first()[0] or 0
        for k in range(1, most + 1):
            self.run(todo.filter(F.col("nth") == k), number * ROUNDS + k)
        self.log.commit(bad)

    def run(self, messages: DataFrame, batch: int) -> None:
        """At most one job of each entity."""
        imports = messages.filter(F.col("job_type").isin(IMPORTS))
        failed = self.read_files(imports, batch) if not imports.isEmpty() else None
        entities = cut_lineage(messages.filter(F.col("job_type").isin(RATES) & F.col("entity").isNotNull()).select("entity").distinct())
        self.assign(entities, batch)
        self.rate(entities, batch)
        self.project(entities, batch)
        rows = messages.select("job_id", "entity", "job_type")
        known = rows.join(failed, "job_id", "left") if failed is not None else rows.withColumn("error", F.lit(None).cast("string"))
        self.log.commit(known.withColumn("status", F.when(F.col("error").isNull(), "complete").otherwise("failed")))

    def read_files(self, imports: DataFrame, batch: int) -> DataFrame:
        """Take in the statement files of import jobs, ``metadata {path, account}``; ``(job_id, error)`` of jobs that name none or whose file cannot be read."""
        asked = imports.select("job_id", F.get_json_object("metadata", "$.path").alias("path"), F.get_json_object("metadata", "$.account").try_cast("bigint").alias("account"))
        asked = cut_lineage(asked.withColumn("file", F.element_at(F.split("path", "/"), -1)))
        paths = [r.path for r in asked.filter("path is not null").select("path").distinct().collect()]  # the files of a batch of jobs
        if not paths:
            return asked.select("job_id", F.lit("no file").alias("error"))
        records = cut_lineage(folder.scan_folder(self.spark, paths, self.mappings))
        rows = folder.transactions(records).join(asked, "file")
        row = F.bitwise_not(F.lit(0).cast("bigint")).bitwiseAND(F.xxhash64("job_id", "line"))
        rows = rows.select(row.alias("row"), "account", "date", "cents", "merchant", "imported_id")
        corrections.correct(self.transactions, self.batches, rows, batch, self.settings.dedup_days, self.settings.amount_tolerance, self.settings.settlement_days)
        whole = folder.problems(records).filter("line is null").select("file", "problem")
        return asked.join(whole, "file", "left").select("job_id", F.when(F.col("path").isNull() | F.col("account").isNull(), "no file or account").otherwise(F.col("problem")).alias("error")).filter("error is not null")

    def of_entities(self, entities: DataFrame) -> DataFrame:
        """Stored transactions of some entities, with their entity and institution."""
        own = self.accounts.join(entities, "entity", "left_semi").select("account", "entity")
        return corrections.of_accounts(self.transactions, own).join(own, "account").withColumn("institution", F.lit(None).cast("string"))

    def assign(self, entities: DataFrame, batch: int) -> None:
        """Match all transactions of the entities, keep proposals for what no entry takes, match those too, and split interrupted entries."""
        txns = cut_lineage(self.of_entities(entities))
        known = cut_lineage(self.entries.read().join(entities, "entity", "left_semi"))
        settled = known.filter("not (source = 'engine' and status = 'pending')")
        rest = txns.join(self._matched(txns, settled).select("id"), "id", "left_anti")  # what is pending is proposed anew, under its old id
        as_of = txns.agg(F.max("date").alias("as_of"))  # one row
        found = cluster.propose(rest, ("entity",)).crossJoin(F.broadcast(as_of))
        fresh = cut_lineage(proposals.keep(known, found, F.col("as_of")))
        mine = settled.unionByName(fresh)
        taken = cut_lineage(self._matched(txns, mine).join(txns.select("id", "entity", "date"), "id"))
        rows, parts = map(cut_lineage, proposals.split(proposals.pulled_back(mine, taken), taken))
        self.entries.commit(rows.join(proposals.unbacked(rows, parts), "entry", "left_anti"), known.select("entity").distinct(), "detect", batch)
        persist.save_assignments(self.assignments, parts.select("entity", F.col("id").alias("transaction"), "entry", "fit"), entities, batch)

    def _matched(self, txns: DataFrame, entries: DataFrame) -> DataFrame:
        """Matches of entries that are no parts: those follow from their entry's."""
        table = entries.filter("part_of is null").select("entity", "entry", F.lit(100).alias("priority"), "label", "conditions", F.lit(None).cast(MATCHED[6:-1]).alias("facts"))
        return match.first_pass(txns.drop("entry", "label"), match.compile_table(table))

    def rate(self, entities: DataFrame, batch: int) -> None:
        """Bring the entities' snapshots up to date."""
        txns = self.of_entities(entities).select("id", "date", "cents")
        taken = self.assignments.read().join(entities, "entity", "left_semi").select(F.col("transaction").alias("id"), "entry")
        mine = self.entries.read()
        counts = R.day_counts(txns.join(taken, "id"))
        before = self.snapshots.entries.read().join(entities, "entity", "left_semi")
        every = mine.join(entities, "entity", "left_semi").select("entry").unionByName(before.select("entry")).distinct()
        moved = cut_lineage(crawl.difference(self.snapshots, counts, every))
        crawl.crawl(self.snapshots, mine, moved, self.settings.window_days, batch)

    def project(self, entities: DataFrame, batch: int) -> None:
        """All projected days of the entities anew, from their latest snapshots."""
        live = self.snapshots.entries.read().join(entities, "entity", "left_semi").filter("status in ('live', 'pending')")
        latest = latest_per_entry(self.snapshots.snapshots.read().filter("node_type = 'entry'").withColumnRenamed("node", "entry")).select("entry", "actual", "projected")
        last = self.snapshots.days.read().groupBy("entry").agg(F.max("date").alias("last_date"))
        rows = live.join(self.entries.read().select("entry", "anchor"), "entry").join(latest, "entry").join(last, "entry")
        rows = rows.withColumn("due", next_due_date(F.col("anchor"), F.col("period_days"), F.col("last_date"))).withColumn("rate", projection.projected_rate(F.col("actual"), F.col("projected")).cast("bigint"))
        balances = self.accounts.join(entities, "entity", "left_semi").groupBy("entity").agg(F.sum("balance").alias("balance"))
        days = projection.project(rows.join(balances, "entity"), ["entity"], horizon=self.settings.horizon_days)
        persist.save_projections(self.projections, days, entities, batch)


def run_engine(engine: Engine, inbox: str, checkpoint: str) -> StreamingQuery:
    """Work off all waiting messages of a folder of JSON lines; a restart delivers the batch that broke off again."""
    stream = jobs.parse_messages(engine.spark.readStream.text(inbox))
    return stream.writeStream.foreachBatch(engine.handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
