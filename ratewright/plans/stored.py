"""Queries on stored tables: what a reader finds after commits."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ratewright.checkpoints import new_folder
from ratewright.operators import crawl, persist
from ratewright.operators import rates as ops
from ratewright.registry import QUERIES, query
from ratewright.sources import adapters as A
from ratewright.sources import folder

from . import sql as Q


def _wrong(txns):
    """Transactions of one entity's late days with amounts that a later batch sets right."""
    return txns.filter("entity = 2 and date >= date'2024-01-20'").withColumn("cents", F.col("cents") * 2 + 1)


@query("M17_M11_T03_dirty_crawl", QUERIES["M16_M17_U01_snapshots"].sql)
def _m17(spark, sf):
    """A full run over amounts some of which are wrong, then a run over the corrections alone."""
    txns = A.transactions(spark, sf)
    entries, rows = A.entries(txns), txns.select("entry", "date", "cents")
    store = crawl.SnapshotStore.at(spark, new_folder(spark, "crawl"), 4)
    wrong = _wrong(txns).select(rows.columns)
    right = txns.filter("entity = 2 and date >= date'2024-01-20'").select(rows.columns)
    first = txns.filter("not (entity = 2 and date >= date'2024-01-20')").select(rows.columns).unionByName(wrong)
    crawl.crawl(store, entries, crawl.moved_counts(first, None), Q.WINDOW, 0)
    crawl.crawl(store, entries, crawl.moved_counts(right, wrong), Q.WINDOW, 1)
    return store.snapshots.read().select(ops.SNAPSHOT)


@query("K02_stored_assignments", Q.T + " select entity, id as transaction, entry, 0.5 as fit from txn where entity <> 2 union all select 2, id, entry, 0.9 from txn where entity = 2 and id % 2 = 0")
def _k02(spark, sf):
    t = A.transactions(spark, sf).select("entity", F.col("id").alias("transaction"), "entry")
    table = persist.assignments_at(spark, new_folder(spark, "assignments"))
    persist.save_assignments(table, t.withColumn("fit", F.lit(0.5)), t.select("entity"), 0)
    new = t.filter("entity = 2 and transaction % 2 = 0")
    for batch in (1, 1):  # delivered twice
        persist.save_assignments(table, new.withColumn("fit", F.lit(0.9)).unionByName(new.withColumn("fit", F.lit(0.2))), spark.range(2, 3).select(F.col("id").alias("entity")), batch)
    return table.read()


@query("K04_stored_projections", QUERIES["M19_W08_projection"].sql)
def _k04(spark, sf):
    rows = QUERIES["M19_W08_projection"].build(spark, sf)
    table = persist.projections_at(spark, new_folder(spark, "projections"))
    stale = rows.withColumns({"date": F.date_sub("date", 30), "balance": F.lit(0).cast("bigint")})
    persist.save_projections(table, stale, rows.select("entity"), 0)
    persist.save_projections(table, rows, rows.select("entity"), 1)
    return table.read()


@query("K01_K05_stored_import", Q.O + """, stored as (select id, entry as account, date, cents, merchant from ord where id % 2 = 0),
    cand as (select id + 10000000 as id, entry as account, date, cents, merchant, id % 2 = 0 as there, date >= date '2001-01-01' as young from ord where id % 3 <> 0)
    select id, account, cents, 'flux' as settlement_status from cand where not there or young
    union all select id, account, cents, case when date < date '2001-01-01' then 'settled' else 'flux' end from stored where id % 3 = 0 or date < date '2001-01-01'""")
def _k01(spark, sf):
    """All orders of even ids stored; two in three orders come in, those stored already by the ids they were imported with."""
    o = A.orders(spark, sf).withColumn("account", F.col("entry")).withColumn("imported_id", F.col("id").cast("string"))
    settled = F.when(F.col("date") < F.lit("2001-01-01").cast("date"), "settled").otherwise("flux")
    stored = o.filter("id % 2 = 0").withColumn("settlement_status", settled)
    transactions, batches = persist.transactions_at(spark, new_folder(spark, "transactions"), 4), persist.batches_at(spark, new_folder(spark, "batches"))
    transactions.commit(stored.select(transactions.schema.names))
    there = transactions.read().select(F.col("imported_id"), F.col("id").alias("stored_id"), "settlement_status")
    candidates = o.filter("id % 3 <> 0").withColumn("row", F.col("id") + 10000000)
    action = F.when(F.col("stored_id").isNull(), "insert").when(F.col("settlement_status") == "flux", "supersede").otherwise("skip")
    actions = candidates.join(there, "imported_id", "left").select("row", "stored_id", action.alias("action"))
    for batch in (0, 0):
        persist.save_import(transactions, batches, candidates, actions, batch)
    return transactions.read().select("id", "account", "cents", "settlement_status")


#: Layouts that orders are written in, a third each: mapping, and columns by name.
_LAYOUTS = {
    "signed": ({"date": "Date", "merchant": "Payee", "amount": "Amount", "imported_id": "Ref"}, {"Date": "cast(date as string)", "Payee": "merchant", "Amount": "amount", "Ref": "cast(id as string)"}),
    "indicator": ({"date": "When", "merchant": "What", "amount": "Sum", "dc_indicator": "Type", "imported_id": "No"}, {"When": "date_format(date, 'M/d/yyyy')", "What": "merchant", "Type": "if(cents < 0, 'DR', 'CR')", "Sum": "ltrim('-', amount)", "No": "cast(id as string)"}),
    "split": ({"date": "day", "merchant": "text", "debit": "out", "credit": "in", "imported_id": "id"}, {"id": "cast(id as string)", "out": "if(cents < 0, ltrim('-', amount), '')", "in": "if(cents < 0, '', amount)", "text": "merchant", "day": "date_format(date, 'd-MMM-yyyy')"}),
}


@query("S01_S05_statement_folder", Q.O + " select cast(id as varchar) as imported_id, date, cents, merchant as imported_payee from ord")
def _s01(spark, sf):
    """All orders written as statement files of three layouts, and read back in one scan."""
    amount = "concat(if(cents < 0, '-', ''), cast(abs(cents) div 100 as string), '.', lpad(cast(abs(cents) % 100 as string), 2, '0'))"
    orders, path = A.orders(spark, sf).withColumn("amount", F.expr(amount)), new_folder(spark, "statements")
    mappings = []
    for k, (layout, (fields, columns)) in enumerate(_LAYOUTS.items()):
        third = orders.filter(F.pmod("id", F.lit(3)) == k)
        third.select(*(F.expr(e).alias(c) for c, e in columns.items())).write.csv(f"{path}/{layout}", header=True)
        names = spark.read.format("binaryFile").load(f"{path}/{layout}").select(F.element_at(F.split("path", "/"), -1).alias("file"))
        mappings.append(names.withColumn("mapping", F.lit(json.dumps({"layout": layout, "fields": fields}))))
    records = folder.scan_folder(spark, f"{path}/*", mappings[0].unionByName(mappings[1]).unionByName(mappings[2]))
    return folder.transactions(records).select("imported_id", "date", "cents", "imported_payee")
