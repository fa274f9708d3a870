"""The index of entries: accesses, blocks, and that it finds what trying all entries finds, at the price of the matches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ratewright.operators import entry_index as index
from ratewright.operators import match

EXACT, PART, OTHER = {"type": "payee_exact", "value": "Kiosk"}, {"type": "payee_contains", "value": "osk"}, {"type": "payee_regex", "value": "^K"}
AMOUNT = {"type": "amount_range", "min_cents": -500, "max_cents": -100}


def tree(op, *children):
    return {"op": op, "children": list(children)}


def test_accesses():
    keys = lambda t: None if (found := index.access_of(t)) is None else [f"{k[0]}{k[1]}{k[2]}" for k in found]
    assert keys(tree("AND", OTHER, AMOUNT, PART)) == ["00cents", "01part"] and keys(tree("AND", AMOUNT, OTHER)) == ["00cents"]
    assert keys(tree("OR", EXACT, AMOUNT)) == ["00exact", "10cents"] and keys(tree("OR", EXACT, OTHER)) is None
    assert keys(tree("AND", tree("OR", EXACT, PART), AMOUNT)) == ["00exact", "00part", "01cents"] and keys(tree("XOR", EXACT, AMOUNT)) == ["00exact", "10cents"]
    assert keys(tree("OR", tree("AND", AMOUNT, EXACT), PART)) == ["00cents", "01exact", "10part"] and keys(tree("OR", EXACT, tree("OR"))) == ["00exact"]
    assert keys(tree("NOT", EXACT)) is None and keys(tree("AND")) is None and keys(tree("OR")) == [] and keys(tree("AND", EXACT, tree("OR"))) == []
    assert keys({"type": "payee_contains", "value": ""}) is None and keys({"type": "date_range", "start": "x", "end": "2024-01-01"}) is None


def test_blocks_make_up_the_range(spark):
    rng = random.Random(2)
    ranges = [(a, a + rng.choice([0, 1, 7, 300])) for a in [-70, -1, 0, 3, 64, *(rng.randrange(-999, 999) for _ in range(30))]] + [(-(1 << 61), 5), (-3, (1 << 61) - 1), (4, 3)]
    rows = spark.createDataFrame(ranges, "low long, high long").select("low", "high", index.blocks_of(F.col("low"), F.col("high")).alias("b")).collect()
    for r in rows:
        spans = sorted((b.block << b.level, ((b.block + 1) << b.level) - 1) for b in r.b)
        assert all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:])) and len(spans) <= 2 * 62
        assert (spans[0][0], spans[-1][1]) == (r.low, r.high) if r.low <= r.high else not spans


def leaf(rng, words):
    kind = rng.choice(["payee_exact", "payee_contains", "payee_starts_with", "payee_ends_with", "imported_payee_one_of", "amount_range", "date_range", "account_id"])
    if kind == "imported_payee_one_of":
        return {"type": kind, "value": [" ".join(rng.sample(words, 2)) for _ in range(3)]}
    if kind == "amount_range":
        low = rng.randrange(-9000, 0)
        return {"type": kind, "min_cents": low, "max_cents": low + 5}
    if kind == "date_range":
        start = dt.date(2024, 1, 1) + dt.timedelta(rng.randrange(3000))
        return {"type": kind, "start": str(start), "end": str(start + dt.timedelta(1))}
    if kind == "account_id":
        return {"type": kind, "value": str(rng.randrange(4000))}
    text = " ".join(rng.sample(words, 2)).upper()
    return {"type": kind, "value": text if kind == "payee_exact" else text[:6] if kind == "payee_starts_with" else text[-6:] if kind == "payee_ends_with" else text[2:9]}


def meets(x, row):
    name, kind = row[1].lower(), x["type"]
    if kind == "imported_payee_one_of":
        return name in [v.lower() for v in x["value"]]
    if kind == "amount_range":
        return x["min_cents"] <= row[3] <= x["max_cents"]
    if kind == "date_range":
        return x["start"] <= str(row[2]) <= x["end"]
    if kind == "account_id":
        return row[4] == x["value"]
    value = x["value"].lower()
    return {"payee_exact": name == value, "payee_contains": value in name, "payee_starts_with": name.startswith(value), "payee_ends_with": name.endswith(value)}[kind]


@pytest.mark.parametrize("shared", [False, True])
def test_ten_thousand_entries_of_one_entity(spark, shared):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(300)]
    rows = [(i, " ".join(rng.sample(words, 2)).title(), dt.date(2024, 1, 1) + dt.timedelta(rng.randrange(3000)), rng.randrange(-9000, 0), str(rng.randrange(4000)), "one") for i in range(400)]
    trees = [leaf(rng, words) if k % 4 else tree("OR", leaf(rng, words), leaf(rng, words)) for k in range(10_000 if not shared else 1000)]
    entries = [match.Entry(f"e{k}", t, entity=None if shared else "one") for k, t in enumerate(trees)]
    entries.append(match.Entry("bad", tree("NAND"), entity="one"))
    txns = spark.createDataFrame([*rows, (1000, None, None, None, None, "one"), (1001, "Other", dt.date(2024, 1, 1), -1, "1", "two")], "id long, merchant string, date date, cents long, account string, entity string").withColumn("institution", F.lit("x"))
    table = match.entry_table(spark, entries)
    got = {(r.id, r.entry) for r in match.first_pass(txns, table).collect() if r.id < 1000}
    want = {(row[0], f"e{k}") for k, t in enumerate(trees) for row in rows if any(meets(x, row) for x in t.get("children", [t]))}
    assert got == want and len(want) > 300
    if not shared:
        assert match._met(txns, match._sound(table)).count() == len(want)


def test_the_alternative_with_fewest_transactions_is_taken(spark):
    txns = spark.createDataFrame([(i, "Kiosk", dt.date(2024, 1, 1), -i, str(i % 50)) for i in range(500)], "id long, merchant string, date date, cents long, account string")
    entries = [match.Entry("a", tree("AND", EXACT, {"type": "account", "value": "7"})), match.Entry("b", tree("AND", EXACT, {"type": "amount_range", "min_cents": -12, "max_cents": -10}, {"type": "account", "value": "7"})), match.Entry("c", tree("AND", EXACT, {"type": "account", "value": "none"}))]
    met = match._met(txns, match._sound(match.entry_table(spark, entries)))
    assert sorted((r.entry, r["count"]) for r in met.groupBy("entry").count().collect()) == [("a", 10), ("b", 3)]
    assert {r.entry for r in match.first_pass(txns, entries).collect()} == {"a"}


def test_partners_of_an_interval_need_not_meet_the_amount(spark):
    entry = match.Entry("a", tree("AND", {"type": "recurrence_anchor", "recurrence_anchor": "interval:30"}, AMOUNT))
    txns = spark.createDataFrame([(1, "x", dt.date(2024, 1, 1), -200), (2, "y", dt.date(2024, 1, 31), -9000), (3, "z", dt.date(2024, 5, 1), -200)], "id long, merchant string, date date, cents long")
    assert [r.id for r in match.first_pass(txns, [entry]).collect()] == [1]


def test_entries_from_a_table_have_the_same_access(spark):
    import json

    trees = [EXACT, tree("OR", PART, AMOUNT), OTHER, tree("OR"), {"type": "date_range", "start": "2024-01-01", "end": "2024-02-01"}]
    given = match.entry_table(spark, [match.Entry(f"e{k}", t) for k, t in enumerate(trees)])
    stored = given.select("entity", "entry", "priority", "label", "facts").join(spark.createDataFrame([(f"e{k}", json.dumps(t)) for k, t in enumerate(trees)], "entry string, conditions string"), "entry")
    columns = ["entry", "shape", "leaf_values", "every", "access", "error"]
    assert sorted(map(tuple, match.compile_table(stored).select(columns).collect())) == sorted(map(tuple, given.select(columns).collect()))
