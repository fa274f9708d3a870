"""Stored tables: commits, pointers, broken runs, repeated batches; and the crawl that keeps snapshots in them."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ratewright.operators import crawl, rates
from ratewright.store import ConflictError, StoredTable

ROW = "entity string, node string, date date, value double"
KEYS = ["entity", "node", "date"]
DAY = dt.date(2024, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    return StoredTable(spark, str(tmp_path / "t"), ROW, KEYS, {"month": "date_format(date, 'yyyy-MM')"})


def frame(spark, rows):
    return spark.createDataFrame(rows, ROW)


def test_upsert_twice_is_once(spark, table):
    first = frame(spark, [("a", "x", day(0), 1.0), ("a", "y", day(40), 2.0)])
    table.commit(first)
    once = rows_of(table.read())
    table.commit(first)
    assert rows_of(table.read()) == once and table.manifest().version == 2
    table.commit(frame(spark, [("a", "x", day(0), 5.0), ("b", "x", day(0), 3.0), ("b", "x", day(0), 4.0)]))
    assert {(r.entity, r.node): r.value for r in table.read().collect()} == {("a", "x"): 5.0, ("a", "y"): 2.0, ("b", "x"): 4.0}
    assert rows_of(table.read(version=1)) == once


def test_only_touched_partitions_are_rewritten(spark, table):
    table.commit(frame(spark, [("a", "x", day(k * 31), float(k)) for k in range(4)]))
    before = table.manifest().folders
    table.commit(frame(spark, [("a", "x", day(31), 9.0)]))
    after = table.manifest().folders
    assert [p for p in before if before[p] != after[p]] == [("2024-02",)]
    table.commit(deletes=spark.createDataFrame([(day(0),)], "date date"))
    assert set(table.manifest().folders) == {("2024-02",), ("2024-03",), ("2024-04",)} and table.manifest().folders[("2024-03",)] == before[("2024-03",)]
    assert rows_of(table.read(only=[("2024-02",), ("2030-01",)])) == [("a", "x", day(31), 9.0)]


def test_deletes_by_any_column(spark, table):
    table.commit(frame(spark, [(e, n, day(k), 1.0) for e in "ab" for n in "xy" for k in (0, 40)]))
    table.commit(frame(spark, [("a", "z", day(3), 7.0)]), deletes=spark.createDataFrame([("a",)], "entity string"))
    assert sorted((r.entity, r.node) for r in table.read().collect()) == [("a", "z"), *[("b", n) for n in "xxyy"]]
    table.commit(deletes=table.read().select("entity"))
    assert table.read().count() == 0 and table.manifest().folders == {}


def test_a_broken_run_leaves_the_old_version(spark, table):
    table.commit(frame(spark, [("a", "x", day(0), 1.0)]))
    before = rows_of(table.read())

    def killed():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        table.commit(frame(spark, [("a", "x", day(0), 2.0)]), before_publish=killed)
    assert rows_of(table.read()) == before and len(table.folder.names("data")) == 2
    table.vacuum()
    assert rows_of(table.read()) == before and len(table.folder.names("data")) == 1
    table.commit(frame(spark, [("a", "x", day(0), 2.0)]))
    assert [r.value for r in table.read().collect()] == [2.0]


def test_overtaken_commits_start_anew(spark, table):
    table.commit(frame(spark, [("a", "x", day(0), 1.0)]))
    other = StoredTable(spark, table.path, ROW, KEYS, {"month": "date_format(date, 'yyyy-MM')"})
    once = iter([True])
    table.commit(frame(spark, [("a", "y", day(0), 2.0)]), before_publish=lambda: other.commit(frame(spark, [("a", "z", day(1), 3.0)])) if next(once, False) else None)
    assert sorted(r.node for r in table.read().collect()) == ["x", "y", "z"]
    always = lambda: other.commit(frame(spark, [("a", "z", day(1), 3.0)]))
    with pytest.raises(ConflictError):
        table.commit(frame(spark, [("a", "w", day(0), 2.0)]), before_publish=always)
    assert sorted(r.node for r in table.read().collect()) == ["x", "y", "z"]


def test_a_batch_counts_once(spark, table):
    for batch, value in ((0, 1.0), (1, 2.0), (1, 3.0), (0, 4.0)):
        table.commit(frame(spark, [("a", "x", day(0), value)]), writer="w", batch=batch)
    table.commit(frame(spark, [("a", "y", day(0), 9.0)]), writer="other", batch=0)
    assert {r.node: r.value for r in table.read().collect()} == {"x": 2.0, "y": 9.0}


def test_odd_partition_values(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path / "odd"), "k string, v int", ["k"], {"k_": "k"})
    t.commit(spark.createDataFrame([("a/b=c", 1), ("a:b", 2), ("", 3), ("é", 4)], "k string, v int"))
    assert sorted(r.v for r in t.read().collect()) == [1, 2, 3, 4]
    t.commit(deletes=spark.createDataFrame([("a:b",)], "k string"))
    assert sorted(r.v for r in t.read().collect()) == [1, 3, 4]
    t.commit(spark.createDataFrame([], "k string, v int"))
    assert t.read().count() == 3


# --- crawl ---

WINDOW = 7
ENTRY = "entry string, entity bigint, label string, direction string, rate_method string, period_days int, status string, start_date date, end_date date"


def entries_of(spark, txns, seed):
    """Entries as the transactions have them; every third has a start of its own, some labels and methods follow the seed."""
    out = []
    for entry in sorted({t[0] for t in txns}):
        k, own = int(entry[1:]), sorted(t[1] for t in txns if t[0] == entry)
        start = own[0] + dt.timedelta(days=3 if k % 3 == 0 else 0)
        end = day(100) if k % 5 == 4 else None
        out.append((entry, k % 2, None if k == 7 else f"l{(k + (seed if k == 1 else 0)) % 3}", "income" if k % 4 == 0 else "spend", "max" if k % 3 == 1 else "median", 5 + k % 4, "live", start, end))
    return spark.createDataFrame(out, ENTRY)


def txn(rng, low, high):
    return f"e{rng.randrange(10)}", day(rng.randrange(low, high)), rng.choice([-1, 1]) * rng.randrange(1, 5000)


@pytest.fixture
def few_partitions(spark):
    """The tables here are small, and each run is many plans."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_dirty_runs_give_what_a_full_run_gives(spark, tmp_path, few_partitions):
    rng = random.Random(4)
    store = crawl.SnapshotStore.at(spark, str(tmp_path / "s"), 3)
    schema = "entry string, date date, cents bigint"
    stored = []
    for batch, (low, high, n, gone) in enumerate([(0, 120, 150, 0), (100, 130, 12, 3), (40, 60, 2, 1), (0, 160, 4, 30)]):
        inserted = [txn(rng, low, high) for _ in range(n)]
        deleted = rng.sample(stored, gone)
        for t in deleted:
            stored.remove(t)
        stored += inserted
        entries = entries_of(spark, stored, batch)
        moved = crawl.moved_counts(spark.createDataFrame(inserted, schema), spark.createDataFrame(deleted, schema))
        if batch == 1:  # breaks off after the counts are stored, and is run again
            commit, store.months.commit = store.months.commit, lambda *a, **b: 1 / 0
            with pytest.raises(ZeroDivisionError):
                crawl.crawl(store, entries, moved, WINDOW, batch)
            store.months.commit = commit
        crawl.crawl(store, entries, moved, WINDOW, batch)
        want = rows_of(rates.snapshots(spark.createDataFrame(stored, schema), entries, WINDOW))
        assert rows_of(store.snapshots.read().select(rates.SNAPSHOT)) == want
    assert store.dirty.read().count() == 0
    assert crawl.difference(store, rates.day_counts(spark.createDataFrame(stored, schema)), entries).count() == 0
