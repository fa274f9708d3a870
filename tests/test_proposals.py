"""Proposals kept, ended and split: a repeated run changes nothing."""

import datetime as dt

from pyspark.sql import functions as F

from ratewright.checkpoints import cut_lineage
from ratewright.operators import cluster, proposals

DAY = dt.date(2025, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


def txns(spark, rows):
    return spark.createDataFrame([(i, 1, day(d), c, m) for i, (d, c, m) in enumerate(rows)], "id long, entity long, date date, cents long, merchant string")


def rows_of(df):
    return sorted(map(repr, df.select(proposals.COLUMNS).collect()))


def test_proposals_are_kept(spark):
    rows = [(30 * k, -4000 - k, "Lumen Power") for k in range(6)] + [(7 * k, -900, "Kiosk") for k in range(5)] + [(30 * k + 1, 90_000, "Salary") for k in range(6)]
    as_of = F.lit(day(151))
    none = spark.createDataFrame([], proposals.ENTRY)
    first = cut_lineage(proposals.keep(none, cluster.propose(txns(spark, rows), ("entity",)), as_of))
    got = {r.label: (r.status, r.alert_type, r.end_date, r.period_days) for r in first.collect()}
    assert got == {"Lumen Power": ("pending", "new", None, 30), "Salary": ("pending", "new", None, 30), "Kiosk": ("pending", "ended", day(35), 7)}
    again = proposals.keep(first, cluster.propose(txns(spark, rows), ("entity",)), as_of)
    assert rows_of(again) == rows_of(first)
    # an earlier row comes in: the same entry, with the new start; live ones and those of people stay as they are
    more = cut_lineage(proposals.keep(first, cluster.propose(txns(spark, [*rows, (-30, -3999, "Lumen Power")]), ("entity",)), as_of))
    ids = {r.label: r.entry for r in first.collect()}
    assert {r.label: r.entry for r in more.collect()} == ids and {r.label: r.start_date for r in more.collect()}["Lumen Power"] == day(-30)
    live = first.withColumn("status", F.lit("live"))
    other = proposals.keep(live, cluster.propose(txns(spark, [*rows, (-30, -3999, "Lumen Power")]), ("entity",)), as_of).collect()
    assert [r.label for r in other] == ["Lumen Power"] and other[0].entry not in ids.values()


def test_interrupted_entries_are_split(spark):
    rows = [(30 * k, -4000, "Lumen") for k in (0, 1, 2, 6, 7, 12, 13)]
    found = cut_lineage(proposals.keep(spark.createDataFrame([], proposals.ENTRY), cluster.propose(txns(spark, rows), ("entity",)), F.lit(day(400))).withColumn("period_days", F.lit(30)))
    assigned = cut_lineage(txns(spark, rows).crossJoin(found.select("entry")).select("entry", "id", "entity", "date", F.lit(1.0).alias("fit")))
    entries, parts = map(cut_lineage, proposals.split(proposals.pulled_back(found.withColumn("start_date", F.lit(day(45))), assigned), assigned))
    got = sorted((r.start_date, r.end_date if r.part_of else None, r.part_of is not None, r.matched if r.part_of else 0) for r in entries.collect())
    assert got == [(day(0), day(60), True, 3), (day(180), day(210), True, 2), (day(360), None, False, 0)]
    starts = {r.entry: r.start_date for r in entries.collect()}
    assert sorted((r.date, starts[r.entry]) for r in parts.collect()) == [(day(30 * k), day(s)) for k, s in ((0, 0), (1, 0), (2, 0), (6, 180), (7, 180), (12, 360), (13, 360))]
    again, same = map(cut_lineage, proposals.split(proposals.pulled_back(entries.filter("part_of is null"), assigned), assigned))
    assert rows_of(again) == rows_of(entries) and sorted(map(tuple, same.collect())) == sorted(map(tuple, parts.collect()))
    left = spark.createDataFrame([(e,) for e in list(starts)[:1]], "entry string")
    assert {r.entry for r in proposals.unbacked(entries, left).collect()} == set(list(starts)[1:])
