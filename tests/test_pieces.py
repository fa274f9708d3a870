"""Pairs of an import, piece by piece: against pairs taken one by one, in one pass and in rounds; and the bounds before the name comparison."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ratewright.functions.text import lcs_ratio
from ratewright.operators import dedup

ROW = "{} long, account long, date date, cents long, merchant string, imported_id string"
DAY = dt.date(2025, 1, 1)


def by_force(mine, theirs, days=3, share=0.005):
    def same(a, b):
        return a[0] == b[0] and abs((a[1] - b[1]).days) <= days and abs(a[2] - b[2]) <= int(abs(a[2]) * share) and a[3] == b[3]

    first = {}
    for side, rows in ((0, mine), (1, theirs)):
        for i, r in enumerate(rows):
            first.setdefault((side, r), i)
    pairs = sorted((abs((a[1] - b[1]).days), abs(a[2] - b[2]), first[1, b], first[0, a], i, j) for i, a in enumerate(mine) for j, b in enumerate(theirs) if same(a, b))
    want, used = {}, set()
    for *_, i, j in pairs:
        if i not in want and j not in used:
            want[i] = j
            used.add(j)
    return want


def chains(rng):
    """Daily purchases that drift in amount, so that each one could be its neighbour; and others scattered."""
    theirs = [(1, DAY + dt.timedelta(k), -10_000 - 17 * k, "Kiosk") for k in range(60)] + [(rng.randrange(1, 4), DAY + dt.timedelta(rng.randrange(90)), -rng.choice([500, 501, 503, 9000, 40_000]), rng.choice(["Mill", "Rent"])) for _ in range(120)]
    mine = [(a, d + dt.timedelta(rng.randrange(3)), c - rng.randrange(9), m) for a, d, c, m in theirs if rng.random() < 0.8]
    return mine, theirs


@pytest.mark.parametrize("limit", [dedup.PIECE_PAIRS, 60, 6])
def test_pairs_are_those_taken_one_by_one(spark, monkeypatch, limit):
    monkeypatch.setattr(dedup, "PIECE_PAIRS", limit)
    mine, theirs = chains(random.Random(11))
    candidates = spark.createDataFrame([(i, *r, None) for i, r in enumerate(mine)], ROW.format("row"))
    stored = spark.createDataFrame([(j, *r, None) for j, r in enumerate(theirs)], ROW.format("id")).withColumn("settlement_status", F.lit("settled"))
    got = dedup.classify(candidates, stored).collect()
    assert {r.row: r.stored_id for r in got if r.stored_id is not None} == by_force(mine, theirs) and len(got) == len(mine)


def test_no_pair_crosses_a_piece(spark):
    rng = random.Random(3)
    rows = sorted({(rng.randrange(2), DAY + dt.timedelta(rng.randrange(60)), rng.choice([-1, 1]) * rng.randrange(1, 3000)) for _ in range(400)})
    for share in (0.005, 0.3):
        pieces = {(r.account, r.date, r.cents): r.piece for r in dedup._pieces(spark.createDataFrame(rows, "account long, date date, cents long"), 2, share).collect()}
        assert len(pieces) == len(rows) and len(set(pieces.values())) > 3
        for a in rows:
            for b in rows:
                if a[0] == b[0] and abs((a[1] - b[1]).days) <= 2 and abs(a[2] - b[2]) <= int(abs(a[2]) * share):
                    assert pieces[a] == pieces[b]


@pytest.mark.parametrize("share", [0.005, 0.5, 0.97, 1.5])
def test_band_join_finds_every_pair(spark, share):
    rng = random.Random(8)
    rows = [(i, 1, DAY + dt.timedelta(rng.randrange(6)), rng.choice([-1, 1]) * rng.choice([0, 1, 2, 3, 199, 200, 201, 399, 400, 401, 10_000, 10_050, 1_000_000, 1_004_999]), "x", None) for i in range(80)]
    left = spark.createDataFrame(rows, ROW.format("row"))
    right = spark.createDataFrame(rows, ROW.format("id")).withColumn("settlement_status", F.lit("flux"))
    got = sorted((r.row, r.s_id) for r in dedup._band_join(left, right, ["account", "merchant"], 2, share).collect())
    assert got == sorted((a[0], b[0]) for a in rows for b in rows if abs((a[2] - b[2]).days) <= 2 and abs(a[3] - b[3]) <= int(abs(a[3]) * share))


def test_bounds_lose_no_similar_name(spark):
    rng = random.Random(4)
    names = ["", "a", "ab", *("".join(rng.choice("abcd e") for _ in range(rng.randrange(3, 12))) for _ in range(40))]
    names += [n + "e" for n in names]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names if a != b], "a string, b string")
    rows = pairs.select((lcs_ratio(F.col("a"), F.col("b")) >= dedup.SIMILAR).alias("similar"), dedup._may_be_similar(F.col("a"), F.col("b")).alias("may")).groupBy("similar", "may").count().collect()
    count = {(r.similar, r.may): r["count"] for r in rows}
    assert (True, False) not in count and count[True, True] > 50 and count[False, False] > 5 * count.get((False, True), 0)
