"""Queries on catalog tables: entries, labels, jobs, accounts, change messages (K, M14, T)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ratewright.operators import lifecycle
from ratewright.registry import query
from ratewright.sources import adapters as A
from ratewright.streaming import jobs

from . import sql as Q


def _entries(spark, sf):
    e = A.entries(A.transactions(spark, sf))
    return e.select(F.col("entry").alias("id"), F.col("entity").cast("string").alias("entity"), F.col("label").alias("label_id"), "direction", F.lit(100).alias("priority"), "status", F.lit("user").alias("source"), "start_date", "end_date")


@query("K10_change_entry", Q.TE + " select entry as id, case entry when '1:view' then 'ended' when '2:click' then 'pending' else status end as status, case entry when '1:view' then date '2024-03-01' else end_date end as end_date from entries")
def _k10(spark, sf):
    ended = lifecycle.end_entry(_entries(spark, sf), "1:view", dt.date(2024, 3, 1))
    return lifecycle.set_status(ended, "2:click", False).select("id", "status", "end_date")


@query("K13_seed_system_entries", Q.TE + " select entry as id, 'user' as source, 100 as priority from entries union all select '3:' || n, 'system', 9999 from (values ('All'), ('Income'), ('Spend')) v(n)")
def _k13(spark, sf):
    once = lifecycle.seed_system_entries(spark, _entries(spark, sf), "3", dt.date(2024, 1, 1))
    return lifecycle.seed_system_entries(spark, once, "3", dt.date(2024, 1, 1)).select("id", "source", "priority")


_JOBS = """with job as (select event_id as id, cast(user_id as varchar) as entity_id, ['import.process', 'export.report', 'account.analyze'][event_id % 3 + 1] as job_type, case when event_id % 2 = 0 then 'complete' else 'queued' end as status from events)"""


def _jobs(spark, sf):
    kinds = F.array(*map(F.lit, ("import.process", "export.report", "account.analyze")))
    status = F.when(F.col("event_id") % 2 == 0, "complete").otherwise("queued")
    return A.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("entity_id"), F.get(kinds, (F.col("event_id") % 3).cast("int")).alias("job_type"), status.alias("status"))


@query("K14_create_jobs", _JOBS + " select * from job union all select c_custkey + 1000000, cast(c_custkey as varchar), 'export.report', 'queued' from customer where not exists (select 1 from job where entity_id = cast(c_custkey as varchar) and job_type = 'export.report' and status = 'queued')")
def _k14(spark, sf):
    c = A.table(spark, sf, "customer")
    twice = c.withColumn("more", F.explode(F.array(F.lit(2000000), F.lit(1000000))))  # two new ones of a kind: one comes in
    wanted = twice.select((F.col("c_custkey") + F.col("more")).alias("id"), F.col("c_custkey").cast("string").alias("entity_id"), F.lit("export.report").alias("job_type"), F.lit("queued").alias("status"))
    return lifecycle.create_job(_jobs(spark, sf), wanted)


@query("K16_T09_change_feed", _JOBS + """ select id, '{"id":' || id || ',"entity_id":"' || entity_id || '","job_type":"' || job_type || '","status":"processing"}' as payload from job where status = 'queued'""")
def _k16(spark, sf):
    before = _jobs(spark, sf)
    after = before.withColumn("status", F.when(F.col("status") == "queued", "processing").otherwise(F.col("status")))
    return lifecycle.changes(before, after)


@query("K17_balances", Q.A + " select a.account, cast(starting + coalesce(sum(cents), 0) as bigint) as balance from accounts a left join txn t on t.account = a.account group by a.account, starting")
def _k17(spark, sf):
    return lifecycle.recalculated_balances(A.accounts(spark, sf), A.transactions(spark, sf)).select("account", "balance")


@query("M14_label_cycles", """with recursive e as (select c_custkey // 50 as entity, c_custkey as label, c_custkey + [0, 1, 1, -2, -1, 1, 1, 9000000, -3, -9][c_custkey % 10 + 1] as input from customer),
r as (select entity, label, input from e union select r.entity, r.label, e.input from r join e on e.entity = r.entity and e.label = r.input),
c as (select distinct entity, label from r where label = input)
select distinct e.entity, e.label from e where exists (select 1 from r join c on c.entity = r.entity and c.label = r.input where r.entity = e.entity and r.label = e.label)""")
def _m14(spark, sf):
    """Of ten labels in a row: one that is its own input, a ring of three, a way into it, two ways that end, a way into one of these, a way into the first."""
    k = F.col("c_custkey")
    step = F.get(F.array(*map(F.lit, (0, 1, 1, -2, -1, 1, 1, 9_000_000, -3, -9))), (k % 10).cast("int"))
    edges = A.table(spark, sf, "customer").select(F.expr("c_custkey div 50").alias("entity"), k.alias("label"), (k + step).alias("input"))
    return lifecycle.label_cycle_nodes(edges)


@query("S12_S13_messages", """with m as (select event_id, event_id % 4 as k, user_id from events) select event_id as id, case k when 1 then null else cast(event_id as varchar) end as job_id,
  case k when 1 then null when 2 then 'unknown' else 'export.report' end as job_type, k in (0, 3) as ok from m""")
def _s12(spark, sf):
    text = F.when(F.col("k") == 1, F.lit("no json")).otherwise(F.to_json(F.struct(F.col("event_id").cast("string").alias("job_id"), F.col("user_id").cast("string").alias("entity_id"), F.when(F.col("k") == 2, "unknown").otherwise("export.report").alias("job_type"))))
    rows = A.table(spark, sf, "events").withColumn("k", F.col("event_id") % 4).select(F.concat_ws("\t", "event_id", text).alias("value"))
    found = jobs.parse_messages(rows.select(F.split("value", "\t", 2)[1].alias("value"), F.split("value", "\t", 2)[0].cast("bigint").alias("id")), keep=("id",))
    return found.select("id", "job_id", "job_type", "ok")
