"""Snapshots kept up to date: a run computes only the days that a change can reach.

A change of an entry's transactions reaches its days from the first changed one on, and
through them the days of its label. What a recomputed day needs from before is stored:
counts by day for the rolling window, counts by month for the usual amount, earlier
snapshots for the trend. A dirty run and its merge give the tables that a full run gives.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright.checkpoints import cut_lineage
from ratewright.operators import rates as R
from ratewright.store import StoredTable

#: Attributes of an entry that its rates depend on.
ATTRIBUTES = ["entity", "label", "direction", "rate_method", "period_days", "status", "start_date"]
#: Groups of nodes that are stored apart, so that a run opens only those it changes.
BUCKETS = 16


def _bucket(node: str, buckets: int) -> str:
    return f"pmod(xxhash64({node}), {buckets})"


def _last(end: str, as_of: str) -> Column:
    return F.least(F.coalesce(end, as_of), F.col(as_of))


@dataclass
class SnapshotStore:
    """The stored tables of a crawl, under one folder.

    ``days``: counts by (entry, date, cents). ``months``: the same by (entry, month, cents). ``entries``:
    the entries of the last run, with its ``as_of``. ``snapshots``: rows of entries and labels.
    ``dirty``: first days that a run has changed and not yet computed; empty but for runs that broke off.
    """

    days: StoredTable
    months: StoredTable
    entries: StoredTable
    snapshots: StoredTable
    dirty: StoredTable

    @classmethod
    def at(cls, spark: SparkSession, path: str, buckets: int = BUCKETS) -> SnapshotStore:
        month = "date_format(date, 'yyyy-MM')"
        entry = "entry string, entity bigint, label string, direction string, rate_method string, period_days int, status string, start_date date, end_date date, as_of date"
        row = "node string, node_type string, date date, actual double, projected double, drift double, slope double, r_squared double, transactions bigint, window_days int, total bigint"
        return cls(
            StoredTable(spark, f"{path}/days", "entry string, date date, cents bigint, n bigint", ["entry", "date", "cents"], {"bucket": _bucket("entry", buckets), "month": month}),
            StoredTable(spark, f"{path}/months", "entry string, month date, cents bigint, n bigint", ["entry", "month", "cents"], {"bucket": _bucket("entry", buckets)}),
            StoredTable(spark, f"{path}/entries", entry, ["entry"]),
            StoredTable(spark, f"{path}/snapshots", row, ["node", "node_type", "date"], {"kind": "node_type", "bucket": _bucket("node", buckets), "month": month}),
            StoredTable(spark, f"{path}/dirty", "entry string, date date", ["entry"]),
        )


def moved_counts(inserted: DataFrame | None, deleted: DataFrame | None) -> DataFrame:
    """``(entry, date, cents, n)``: by how much a change of transactions ``(entry, date, cents)`` moves each count."""
    parts = [rows.select("entry", "date", "cents", F.lit(sign).cast("bigint").alias("n")) for rows, sign in ((inserted, 1), (deleted, -1)) if rows is not None]
    moved = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return moved.groupBy("entry", "date", "cents").agg(F.sum("n").alias("n"))


def difference(store: SnapshotStore, counts: DataFrame, entries: DataFrame) -> DataFrame:
    """``(entry, date, cents, n)``: what leads from the stored counts of ``entries(entry)`` to ``counts``."""
    old = store.days.read(only=[p for p in store.days.manifest().folders if p[0] in _buckets(store, entries)]).join(entries.select("entry"), "entry", "left_semi")
    both = counts.select("entry", "date", "cents", "n").unionByName(old.select("entry", "date", "cents", (-F.col("n")).alias("n")))
    return both.groupBy("entry", "date", "cents").agg(F.sum("n").alias("n")).filter("n <> 0")


def _buckets(store: SnapshotStore, entries: DataFrame) -> set[str]:
    return {p[0] for p in store.months.partitions_of(entries.select("entry"))}


def change_days(store: SnapshotStore, moved: DataFrame, batch: int) -> DataFrame:
    """Bring the stored counts up to date; ``(entry, date)``: the first day of each entry that this or a broken run has touched.

    Touched days are written down before anything else is, so that no break loses them.
    Counts that fall to nothing go.
    """
    moved, pending = cut_lineage(moved), cut_lineage(store.dirty.read())
    keys = ["entry", "date", "cents"]
    touched = moved.select("entry", "date").unionByName(pending).groupBy("entry").agg(F.min("date").alias("date"))
    touched = cut_lineage(touched)
    store.dirty.commit(touched)
    if batch > store.days.manifest().batches.get("crawl", -1):
        old = store.days.read(only=store.days.partitions_of(moved)).withColumnRenamed("n", "old")
        new = moved.join(old, keys, "left").withColumn("n", F.col("n") + F.coalesce("old", F.lit(0))).drop("old")
        new = cut_lineage(new)
        store.days.commit(new.filter("n > 0"), new.filter("n <= 0").select(keys), "crawl", batch)
    months = moved.select("entry", F.trunc("date", "month").cast("date").alias("month"))
    if not pending.isEmpty():  # a broken run may have left any month from its first day on
        late = pending.select("entry", F.trunc("date", "month").cast("date").alias("from"))
        parts = _buckets(store, pending)
        held = store.months.read(only=[(p,) for p in parts]).select("entry", "month")
        held = held.unionByName(store.days.read(only=[p for p in store.days.manifest().folders if p[0] in parts]).select("entry", F.trunc("date", "month").cast("date").alias("month")))
        months = months.unionByName(held.join(late, "entry").filter(F.col("month") >= F.col("from")).select("entry", "month"))
    months = cut_lineage(months.distinct())
    days = store.days.read(only=store.days.partitions_of(months.withColumn("date", F.col("month"))))
    counted = days.withColumn("month", F.trunc("date", "month").cast("date")).join(months, ["entry", "month"], "left_semi").groupBy("entry", "month", "cents").agg(F.sum("n").alias("n"))
    store.months.commit(counted, months)
    return touched


def dirty_since(old: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """``(entry, since)``: the first day that must be computed anew, of every entry that has one.

    ``old`` and ``new`` are entries with ``as_of``. It is the first touched day; the earlier start
    where an attribute changed; the day after the earlier end where the last day moved.
    """
    was = old.select("entry", *(F.col(c).alias(f"old_{c}") for c in ATTRIBUTES), _last("end_date", "as_of").alias("old_last"))
    now = new.select("entry", *ATTRIBUTES, _last("end_date", "as_of").alias("last"))
    first = touched.groupBy("entry").agg(F.min("date").alias("touched"))
    rows = was.join(now, "entry", "full").join(first, "entry", "left")
    differs = ~F.struct(*(F.col(c) for c in ATTRIBUTES)).eqNullSafe(F.struct(*(F.col(f"old_{c}").alias(c) for c in ATTRIBUTES)))
    moved = F.when(~F.col("last").eqNullSafe(F.col("old_last")), F.date_add(F.least("last", "old_last"), 1))
    start = F.least("start_date", "old_start_date")
    since = F.least(F.col("touched"), F.when(differs, start), moved)
    return rows.withColumn("since", since).filter("since is not null").select("entry", F.greatest("since", start).alias("since"))


def _spread(rows: DataFrame, key: str, first: Column, last: Column) -> DataFrame:
    """``(key, date)``: the first days of all months between two days, which tell the partitions there."""
    months = F.sequence(F.trunc(first, "month").cast("date"), F.greatest(F.trunc(last, "month").cast("date"), F.trunc(first, "month").cast("date")), F.expr("interval 1 month"))
    return rows.select(key, F.explode(months).alias("date"))


def _stored(store: SnapshotStore, nodes: DataFrame, kind: str, first: Column, last: Column) -> DataFrame:
    """Stored snapshots of some nodes from a day on, with the columns of ``nodes(node, ...)``."""
    where = _spread(nodes, "node", first, last).withColumn("node_type", F.lit(kind))
    rows = store.snapshots.read(only=store.snapshots.partitions_of(where)).filter(F.col("node_type") == kind)
    return rows.join(nodes, "node").filter(F.col("date") >= first)


def crawl(store: SnapshotStore, entries: DataFrame, moved: DataFrame, window: int, batch: int) -> DataFrame:
    """Bring all stored tables up to date with a batch of moved counts (:func:`moved_counts`, :func:`difference`); ``(entry, since)`` of what was computed anew.

    ``entries`` are all entries as they are after the change; ``window`` is that of all runs.
    Tables are committed one after the other: a run that broke off is repeated with the same
    batch and ends in the same tables, and what it had touched is computed by whatever run
    comes next.
    """
    touched = change_days(store, moved, batch)
    newest = max((p[1] for p in store.days.manifest().folders), default=None)
    of_newest = store.days.read(only=[p for p in store.days.manifest().folders if p[1] == newest])
    before = store.entries.read()
    entries = entries.crossJoin(F.broadcast(R.as_of(of_newest)))
    entries = cut_lineage(entries.select([f.name for f in store.entries.schema]))
    dirty = cut_lineage(dirty_since(before, entries, touched))
    wanted = entries.join(dirty, "entry")

    # counts of the dirty entries: by day from the month before the window on, and in the month that they start in; by month between
    wanted = wanted.withColumn("cut", F.trunc(F.date_sub("since", window), "month").cast("date")).withColumn("begins", F.trunc("start_date", "month").cast("date"))
    own = wanted.select("entry", "cut", "begins", "start_date")
    where = _spread(wanted, "entry", F.col("cut"), F.col("as_of")).unionByName(wanted.select("entry", F.col("begins").alias("date")))
    near = store.days.read(only=store.days.partitions_of(where)).join(own, "entry").filter("date >= start_date and (date >= cut or trunc(date, 'month') = begins)")
    far = store.months.read(only=store.months.partitions_of(own)).join(own, "entry").filter("month < cut and month > begins")
    counts = cut_lineage(near.select("entry", "date", "cents", "n").unionByName(far.select("entry", F.col("month").alias("date"), "cents", "n")))
    first = counts.groupBy("entry").agg(F.min("date").alias("first_date"))  # only a first day within the window counts, and those are days
    fresh = cut_lineage(R.rates_of(counts, wanted.join(first, "entry", "left"), window, begin="since"))

    # trends of entries: stored rates before the first dirty day, within three periods
    known = _stored(store, wanted.select(F.col("entry").alias("node"), "since", "period_days", "as_of"), "entry", F.date_sub("since", 3 * F.col("period_days")), F.col("as_of"))
    known = known.filter("date < since").select(F.col("node").alias("entry"), "date", "actual", "period_days")
    trended = R.trends(fresh.unionByName(known, allowMissingColumns=True), "entry").join(dirty, "entry").filter("date >= since")
    rows = R.entry_snapshots(trended)

    # labels: those that a dirty entry has or had, from its first dirty day on, over all their entries
    both = entries.unionByName(before.select(entries.columns)).filter("label is not null").withColumn("node", R.label_node())
    labels = cut_lineage(both.join(dirty, "entry").groupBy("node").agg(F.min("since").alias("from"), F.max("as_of").alias("as_of")))
    members = entries.withColumn("label_node", R.label_node()).join(labels.select(F.col("node").alias("label_node"), "from"), "label_node")
    others = members.join(dirty, "entry", "left").withColumn("upto", F.col("since")).select(F.col("entry").alias("node"), "entity", "label", "direction", "period_days", "from", "upto", "as_of")
    stored = _stored(store, others, "entry", F.col("from"), F.col("as_of")).filter("upto is null or date < upto")
    columns = ["entity", "label", "direction", "period_days", "date", "actual", "projected", "count"]
    every = fresh.filter("label is not null").select(columns).unionByName(stored.withColumn("count", F.col("transactions")).select(columns))
    of_labels = R.label_rates(every).withColumn("node", R.label_node()).join(labels.select("node", "from"), "node").filter(F.col("date") >= F.col("from")).drop("from")
    of_labels = cut_lineage(of_labels)
    longest = of_labels.groupBy("node").agg(F.max("period_days").alias("longest"))
    asked = labels.join(longest, "node")
    known = _stored(store, asked, "label", F.date_sub("from", 3 * F.col("longest")), F.col("as_of")).filter(F.col("date") < F.col("from")).select("node", "date", "actual", F.col("window_days").alias("period_days"))
    trended = R.trends(of_labels.unionByName(known, allowMissingColumns=True), "node").join(labels.select("node", "from"), "node").filter(F.col("date") >= F.col("from"))
    rows = cut_lineage(rows.unionByName(R.label_snapshots(trended)))

    # days that are no more: stored from the first dirty day on, and not among the new rows
    reach = F.greatest("as_of", "old_as_of")
    ends = before.select("entry", F.col("as_of").alias("old_as_of"))
    nodes = dirty.join(ends, "entry", "left").join(entries.select("entry", "as_of"), "entry", "left").select(F.col("entry").alias("node"), "since", reach.alias("reach"))
    stale = _stored(store, nodes, "entry", F.col("since"), F.col("reach")).select("node", "node_type", "date")
    asked = labels.select("node", F.col("from").alias("since"), F.col("as_of").alias("reach"))
    stale = stale.unionByName(_stored(store, asked, "label", F.col("since"), F.col("reach")).select("node", "node_type", "date"))
    stale = stale.join(rows.select("node", "node_type", "date"), ["node", "node_type", "date"], "left_anti")
    store.snapshots.commit(rows, cut_lineage(stale))
    store.entries.commit(entries, before.join(entries.select("entry"), "entry", "left_anti").select("entry"))
    store.dirty.commit(deletes=touched.select("entry"))
    return dirty
