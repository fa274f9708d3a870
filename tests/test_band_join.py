"""The band join sends few copies of a row, whatever the band."""

import datetime as dt
import random

from pyspark.sql import functions as F

from ratewright.operators import dedup

DAY = dt.date(2025, 1, 1)


def shuffled_rows(spark, run):
    """Rows that the stages of an action write for a shuffle."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def written():
        stages = store.stageList(None, False, False, none, None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = set(written())
    out = run()
    return out, sum(n for stage, n in written().items() if stage not in before)


def test_copies_of_a_row_do_not_grow_with_the_band(spark):
    rng = random.Random(21)
    rows = [(i, i % 9, DAY + dt.timedelta(rng.randrange(400)), rng.choice([-1, 1]) * rng.randrange(20_000_000)) for i in range(600)]
    left = spark.createDataFrame(rows, "row long, account long, date date, cents long").withColumn("merchant", F.lit("x"))
    right = left.withColumnRenamed("row", "id").withColumn("settlement_status", F.lit("flux"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for days, share in ((3, 0.005), (30, 0.5), (200, 0.9)):
            got, sent = shuffled_rows(spark, dedup._band_join(left, right, ["account"], days, share).select("row", "s_id").collect)
            want = [(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and abs((a[2] - b[2]).days) <= days and abs(a[3] - b[3]) <= int(abs(a[3]) * share)]
            assert sorted(map(tuple, got)) == sorted(want) and sent <= 5 * len(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_rows_without_a_date_or_an_amount_meet_nothing(spark):
    rows = spark.createDataFrame([(1, 1, DAY, None), (2, 1, None, 5), (3, 1, DAY, 5)], "row long, account long, date date, cents long").withColumn("merchant", F.lit("x"))
    stored = rows.withColumnRenamed("row", "id").withColumn("settlement_status", F.lit("flux"))
    for share in (0.5, 1.5):
        got = dedup._band_join(rows, stored, ["account"], 3, share).collect()
        assert [(r.row, r.s_id) for r in got] == [(3, 3)]
