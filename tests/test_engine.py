"""Column functions and operators on small literals, and registered queries against their SQL."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from ratewright import plans, registry
from ratewright.functions import conditions as C
from ratewright.functions import dates as D
from ratewright.functions import money as M
from ratewright.functions import text as T
from ratewright.operators import cluster, dedup, lifecycle, match, projection, rates
from ratewright.reports import pages, summary
from ratewright.sources import statements as S
from ratewright.streaming import jobs

d = dt.date.fromisoformat


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.r for r in rows.select("i", expr(F.col("v")).alias("r")).orderBy("i").collect()]


def test_merchants(spark):
    given = ["HARBOUR.BOOKS", "LUMEN.COM*7Q/EU", "TALLOW & WICK", "DROP-OFF POINT", "MILL   WATER", "  KIOSK  ", "RIDGE # 4", "caf\u00e9 N\u00b05!", None, ""]
    assert column(spark, given, T.normalize_merchant) == ["Harbour Books", "Lumen Com 7q Eu", "Tallow & Wick", "Drop-Off Point", "Mill Water", "Kiosk", "Ridge  4", "Caf\u00e9 N5", None, ""]
    assert column(spark, ["Lumen Inc", "Harbour Books Llc", "Usa Corp", "Kiosk 42", "42", "Mill Water"], T.canonical_merchant) == ["Lumen", "Harbour Books", "Usa Corp", "Kiosk", "42", "Mill Water"]


def lcs_by_force(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_lcs(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcd \u00e9") for _ in range(rng.randint(0, 12)))
    pairs = [(word(), word()) for _ in range(200)] + [("", ""), ("x" * 80, "x" * 75), (None, "a"), ("a", None)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [(r.n, r.r) for r in rows.select("i", T.lcs_length(F.col("a"), F.col("b")).alias("n"), T.lcs_ratio(F.col("a"), F.col("b")).alias("r")).orderBy("i").collect()]
    for (a, b), (n, r) in zip(pairs, got):
        if a is None or b is None:
            assert n is None and r is None
        else:
            assert n == lcs_by_force(a, b) and r == pytest.approx(n / max(len(a), len(b)) if a or b else 0.0)


def test_names(spark):
    people = [("Ada Lovelace", "x@y", "Ada Lovelace", "AL"), ("  ada  king noel ", "x@y", "ada  king noel", "AN"), ("Prince", "x@y", "Prince", "PR"), ("Q", "x@y", "Q", "Q"), ("", "me@y", "me@y", "ME"), (None, "m", "m", "?"), (None, None, None, "?")]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(people)], "i int, a string, b string")
    got = [(r.d, r.n) for r in rows.select("i", T.display_name(F.col("a"), F.col("b")).alias("d"), T.initials(F.col("a"), F.col("b")).alias("n")).orderBy("i").collect()]
    assert got == [(x, y) for *_, x, y in people]


def test_money(spark):
    cents = [random.Random(k).randrange(-10**k, 10**k) for k in range(1, 12)]
    assert column(spark, [f"{c / 100:,.2f}" for c in cents], M.parse_cents) == cents
    given = ["7.", "  8 ", "- 1 2.3", "86.429", "5.5x", ".75", "€4", "+3", "-", None]
    assert column(spark, given, M.parse_cents) == [700, 800, -1230, 8642, None, None, None, None, None, None]
    rows = spark.createDataFrame([("a", -1000), ("a", -2000), ("a", -3001), ("a", -3000), ("b", -1000), ("b", -2001), ("c", 5)], "k string, v long")
    assert {r.k: r.m for r in M.grouped_median(rows, ["k"], "v", "m").collect()} == {"a": -2500, "b": -1500, "c": 5}
    assert column(spark, [[1, 2, 4], [-2, -1], []], M.sorted_median, "array<bigint>") == [2, -1, None]


def test_dates(spark):
    for day in (dt.date(2027, 7, 4), dt.date(2023, 11, 30)):
        texts = [day.isoformat(), f"{day.month}/{day.day}/{day.year}", f"{day:%m/%d/%Y}", f"{day.month}/{day.day}/{day:%y}", f"{day.day}-{day:%b}-{day.year}", f" {day:%B} {day.day}, {day.year}"]
        assert column(spark, texts, D.parse_date) == [day] * len(texts)
    assert column(spark, ["tomorrow", "2027-13-01", "4.7.2027", "", None], D.parse_date) == [None] * 5
    days = [d(x) for x in ("2027-03-10", "2027-04-30", "2028-02-29", "2027-05-29", "2027-02-28")]
    assert column(spark, days, D.normalize_dom, "date") == [10, -1, -1, -3, 28]
    due = [("dow:3", "2025-05-07", "2025-05-08"), ("dow:3", "2025-05-08", "2025-05-15"), ("dom:20", "2025-05-19", "2025-05-20"), ("dom:20", "2025-05-20", "2025-06-20"), ("dom:-2", "2024-02-27", "2024-02-28"), ("dom:5,-1", "2025-09-05", "2025-09-30"), ("interval:45", "2025-12-01", "2026-01-15"), (None, "2025-02-01", "2025-03-03"), ("dom:20", None, None)]
    rows = spark.createDataFrame([(i, a, x and d(x)) for i, (a, x, _) in enumerate(due)], "i int, a string, x date")
    got = [r.r for r in rows.select("i", D.next_due_date(F.col("a"), F.lit(30), F.col("x")).alias("r")).orderBy("i").collect()]
    assert got == [x and d(x) for *_, x in due]
    assert column(spark, ["dom:15", "dom:15,-1", "dow:4", "interval:14", "monthly", "", "dom:"], D.anchor_values) == [[15], [15, -1], [4], [14], None, None, None]


@pytest.mark.parametrize("values, first, last, want", [([30], "2024-01-31", "2024-05-30", ["2024-03-30", "2024-04-30", "2024-05-30"]), ([10, -2], "2023-02-05", "2023-04-09", ["2023-02-10", "2023-02-27", "2023-03-10", "2023-03-30"])])
def test_fires(spark, values, first, last, want):
    rows = spark.createDataFrame([(values, d(first), d(last))], "v array<int>, a date, b date")
    assert [str(r.fire) for r in D.dom_fires(rows, "v", "a", "b").orderBy("fire").collect()] == want


def test_plan_time_helpers():
    for cadence, anchor in [("monthly:last", "dom:-1"), ("monthly:15", "dom:15"), ("semimonthly:1,15", "dom:1,15"), ("weekly:friday", "dow:4"), ("every:14", "interval:14")]:
        assert D.anchor_of_cadence(cadence) == anchor and D.cadence_of_anchor(anchor) == cadence
    for bad in ("semimonthly:1", "semimonthly:1,x", "weekly:someday", "yearly:1"):
        with pytest.raises(ValueError):
            D.anchor_of_cadence(bad)
    assert D.add_calendar(d("2026-01-31"), months=1) == d("2026-03-03")
    assert D.resolve_range(d("2026-03-10"), span=(0, 1, 0)) == (d("2026-02-10"), d("2026-03-10"))
    assert D.decode_cursor(D.encode_cursor("a,b", "c")) == ("a,b", "c")
    assert summary.report_name("2026-01-01", None) == "report_from_2026-01-01.csv"


def fits(spark, tree, **row):
    row = {"merchant": "Kiosk", "cents": -1500, "date": "2026-03-15"} | row
    rows = spark.createDataFrame([(row["merchant"], row["cents"], d(row["date"]))], "merchant string, cents long, date date")
    return rows.select(C.compile_tree(tree).alias("f")).first().f


def test_conditions(spark):
    assert fits(spark, {"type": "payee_contains", "value": "ROCE"}, merchant="Corner Grocer") == pytest.approx(0.75 + 0.15 * 4 / 13)
    amount = {"type": "amount_range", "min_cents": -2000, "max_cents": -1000}
    exact = {"type": "payee_exact", "value": "KIOSK"}
    other = {"type": "payee_exact", "value": "Mill"}
    tree = lambda op, *c: {"op": op, "children": list(c)}
    assert fits(spark, tree("AND", exact, amount)) == 1.0 and fits(spark, tree("AND", exact, amount), cents=-500) is None
    assert fits(spark, tree("OR", exact, other)) == 1.0 and fits(spark, tree("NOT", other)) == 1.0
    assert fits(spark, tree("XOR", exact, amount)) is None and fits(spark, tree("XOR", exact, other)) == 1.0
    anchor = lambda a: {"type": "recurrence_anchor", "recurrence_anchor": a}
    for a, day, met in [("dom:12", "2025-08-08", 1), ("dom:12", "2025-08-07", 0), ("dom:-3", "2024-02-25", 1), ("dom:-3", "2024-02-20", 0), ("dom:31", "2025-04-30", 0), ("dom:4,20", "2025-04-12", 0), ("dow:6", "2025-04-13", 1), ("interval:30", "2025-04-13", 0)]:
        assert (fits(spark, anchor(a), date=day) is not None) == bool(met), (a, day)
    for bad in (tree("NAND"), tree("NOT", exact, exact), tree("XOR", exact), {"type": "payee_regex", "value": "("}, {"type": "nothing"}, {"type": "payee_exact"}):
        with pytest.raises(C.ConditionError):
            C.compile_tree(bad)
    with pytest.raises(C.ConditionError):
        C.interval_of(tree("OR", anchor("interval:91"), exact))
    shown = C.to_display(tree("AND", amount, {"type": "account", "value": "id1"}), {"id1": "Checking"})
    assert shown["children"][0]["min"] == -20 and shown["children"][1]["value"] == "Checking"
    assert C.to_storage(shown, {"checking": "id1"}) == tree("AND", amount, {"type": "account", "value": "id1"})


def txns(spark, rows):
    return spark.createDataFrame([(i, m, d(x), c) for i, (m, x, c) in enumerate(rows)], "id long, merchant string, date date, cents long")


def test_interval_phases(spark):
    tree = {"op": "AND", "children": [{"type": "payee_contains", "value": "mill"}, {"type": "recurrence_anchor", "recurrence_anchor": "interval:45"}, {"type": "amount_range", "min_cents": -9000, "max_cents": -7000}]}
    rows = txns(spark, [("Mill", "2025-02-01", -8000), ("Water Mill", "2025-03-20", -8000), ("mill", "2025-05-01", -8100), ("Mill", "2025-04-10", -8000), ("Kiosk", "2025-03-18", -8000), ("Mill", "2025-03-18", -6000)])
    assert sorted(r.id for r in match.first_pass(rows, [match.Entry("a", tree)]).collect()) == [0, 1, 2]


LEAVES = [
    {"type": "payee_exact", "value": "Kiosk"}, {"type": "payee_contains", "value": "I"}, {"type": "payee_not_contains", "value": "w"}, {"type": "payee_starts_with", "value": "mi"}, {"type": "payee_ends_with", "value": "R"},
    {"type": "payee_regex", "value": "^[KM]"}, {"type": "imported_payee_one_of", "value": ["kiosk", "Mill Water"]}, {"type": "amount_range", "min_cents": -100}, {"type": "amount_range", "min_cents": -5000, "max_cents": 100},
    {"type": "date_day_of_month", "day": 15, "tolerance_days": 3}, {"type": "date_range", "start": "2025-01-05", "end": "2025-02-10"}, {"type": "recurrence_anchor", "recurrence_anchor": "dom:3,-1"}, {"type": "recurrence_anchor", "recurrence_anchor": "dow:2"}, {"type": "account", "value": "7"},
]


def test_entries_as_rows_fit_as_their_trees_do(spark):
    """Random trees with their values in rows, against each tree compiled on its own; entities apart."""
    rng = random.Random(21)

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return dict(rng.choice(LEAVES))
        op = rng.choice(["AND", "OR", "NOT", "XOR"])
        return {"op": op, "children": [tree(depth - 1) for _ in range({"NOT": 1, "XOR": 2}.get(op, rng.randint(0, 3)))]}

    data = [(i, rng.choice("ab"), rng.choice(["Kiosk", "Mill Water", "Harbour Grocer", ""]), dt.date(2025, 1, 1) + dt.timedelta(rng.randint(0, 60)), rng.randint(-6000, 500), rng.choice(["7", "8"])) for i in range(80)]
    rows = spark.createDataFrame(data, "id long, entity string, merchant string, date date, cents long, account string")
    entries = [match.Entry(f"e{k}", tree(3), entity=rng.choice(["a", "b", None])) for k in range(40)] + [match.Entry("bad", {"op": "NAND"}), match.Entry("worse", {"type": "payee_regex", "value": "("}, entity="a")]
    got = sorted((r.id, r.entry, round(r.fit, 9)) for r in match.first_pass(rows, entries).collect())
    fits_ = rows.select("id", "entity", *(C.compile_tree(e.tree).alias(e.id) for e in entries[:40])).collect()
    assert got == sorted((r.id, e.id, round(r[e.id], 9)) for r in fits_ for e in entries[:40] if r[e.id] is not None and e.entity in (None, r.entity)) and got
    errors = {r.entry for r in match.entry_table(spark, entries).filter("error is not null").collect()}
    assert errors == {"bad", "worse"}


def test_plan_size_does_not_follow_entries(spark):
    rows = txns(spark, [("Kiosk", "2025-01-01", -5)])
    sizes = []
    for n in (3, 300):
        entries = [match.Entry(f"e{k}", {"op": "AND", "children": [{"type": "payee_exact", "value": f"m{k}"}, {"type": "amount_range", "max_cents": k}]}) for k in range(n)]
        sizes.append(len(match.first_pass(rows, entries)._jdf.queryExecution().optimizedPlan().toString().splitlines()))
    assert sizes[0] == sizes[1]


def test_trends_by_running_sums(spark):
    rng = random.Random(31)
    data = [(k, dt.date(2025, 1, 1) + dt.timedelta(i), round(rng.uniform(-9e4, 9e4), 4) if k != "flat" else 12.5, {"a": 2, "b": 9, "flat": 5}[k] + (i % 3 if k == "b" else 0)) for k in ("a", "b", "flat") for i in range(60) if k != "b" or i % 7 != 3]
    got = {(r.node, r.date): (r.slope, r.r_squared) for r in rates.trends(spark.createDataFrame(data, "node string, date date, actual double, period_days int"), "node").collect()}
    for k, x, _, p in data:
        held = [((y - x).days, v) for j, y, v, _ in data if j == k and 0 <= (x - y).days <= 3 * p]
        n, mx, my = len(held), sum(a for a, _ in held) / len(held), sum(v for _, v in held) / len(held)
        sxx, syy, sxy = sum((a - mx) ** 2 for a, _ in held), sum((v - my) ** 2 for _, v in held), sum((a - mx) * (v - my) for a, v in held)
        slope, fit = (sxy / sxx, sxy * sxy / sxx / syy if syy > 1e-9 else 1.0) if n > 1 else (0.0, 0.0)
        assert got[k, x] == (pytest.approx(slope, abs=2e-6), pytest.approx(fit, abs=2e-3))


def same_as_sql(spark, name, sf="/root/testdata/sf0.001"):
    con = duckdb.connect()
    for t in ("events", "orders", "customer", "nation"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    q = registry.QUERIES[name]
    frame = q.build(spark, sf)
    got = sorted(tuple(r) for r in frame.collect())
    return got, got == sorted(con.execute(f"select {', '.join(frame.columns)} from ({q.sql})").fetchall())


def test_interval_chain_takes_all_orders(spark):
    got, same = same_as_sql(spark, "M03_J12_interval_chain")
    assert same
    orders = [(r.id, r.entry, r.date) for r in plans.matching.A.orders(spark, "/root/testdata/sf0.001").select("id", "entry", "date").collect()]
    held = {}
    for _, e, x in orders:
        held.setdefault(e, []).append(x)
    assert got == sorted((i, e) for i, e, x in orders if any(87 <= abs((x - y).days) <= 95 for y in held[e])) and any(e % 10 for _, e in got)


@pytest.mark.parametrize("name", ["M02_first_pass", "M04_second_pass"])
def test_passes_take_all_entities(spark, name):
    got, same = same_as_sql(spark, name)
    entity = {r.id: r.entity for r in plans.matching.A.transactions(spark, "/root/testdata/sf0.001").select("id", "entity").collect()}
    assert same and {entity[i] for i, *_ in got} == set(range(5))


def test_clusters_and_anchors(spark):
    rows = txns(spark, [("Old Harbour Grocer K-2847", "2025-01-01", -5), ("Grocer Llc", "2025-01-01", -5), ("Grocer K-2847", "2025-01-01", -5), ("Kiosk", "2025-01-01", -5)])
    assert {r.cluster for r in cluster.clustered(rows).collect()} == {"Grocer", "Kiosk"}
    cases = {
        "one": (["2025-03-09"], None), "thursday": (["2025-05-01", "2025-05-08", "2025-05-15", "2025-05-22"], "dow:3"), "mid": (["2025-02-20", "2025-03-20", "2025-04-20"], "dom:20"),
        "last": (["2025-01-31", "2025-02-28", "2025-03-31", "2025-04-30"], "interval:30"), "near": (["2025-06-09", "2025-07-10", "2025-08-09"], "dom:9"), "twice": (["2025-01-04", "2025-01-19", "2025-02-04", "2025-02-19"], "dom:4,19"),
        "quarter": (["2025-01-15", "2025-04-16", "2025-07-16"], "interval:91"), "fortnight": (["2025-03-03", "2025-03-18", "2025-04-02"], "interval:15"),
    }
    flat = [(m, x, -1499) for m, (days, _) in cases.items() for x in days]
    got = {r.merchant: r.anchor for r in cluster.anchors(txns(spark, flat), "merchant").collect()}
    # the last days of months that differ in length are -1, but for a February they are 28, too far from it
    assert got == {m: a for m, (_, a) in cases.items()}
    scores = {r.merchant: r for r in cluster.score(txns(spark, flat), "merchant").collect()}
    assert scores["one"].entry_type == "variable" and scores["one"].fitness == pytest.approx(0.8) and scores["mid"].entry_type == "standing"


def test_expanding_median_and_gaps_keep_no_list(spark):
    rng = random.Random(3)
    given = [(i, rng.choice(["a", "b", None]), dt.date(2025, 1, 1) + dt.timedelta(rng.randint(0, 30)), rng.choice([None, 0, -5, 7, -1600, 2**40, rng.randint(-3000, 3000)])) for i in range(300)]
    given.append((300, "none", d("2025-01-01"), None))
    rows = spark.createDataFrame(given, "id long, entry string, date date, cents long")
    usual = rates.usual_amounts(rows)
    got = {(r.entry, r.date): (r.median, r.max) for r in usual.collect()}
    days = {(e, x) for _, e, x, _ in given}
    want = {}
    for e, x in days:
        held = sorted(abs(c) for _, f, y, c in given if f == e and y <= x and c is not None)
        want[e, x] = ((held[(len(held) - 1) // 2] + held[len(held) // 2]) // 2, held[-1]) if held else (None, None)
    assert got == want
    spaced = cluster.gaps(rows, "entry")
    last, gap = {}, {}
    for i, e, x, _ in sorted(given, key=lambda r: (r[2], r[0])):
        gap[i] = (x - last[e]).days if e in last else None
        last[e] = x
    assert {r.id: r.gap for r in spaced.collect()} == gap
    # windows see days, not transactions, and no list is gathered
    for frame in (usual, spaced):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and not [x for x in plan.splitlines() if "Window [" in x and "id#" in x.split("], [")[-1]]


def test_coverage(spark):
    cases = [(None, "2027-04-10", 12, "2027-04-09", False), (None, "2027-04-10", 12, "2027-04-21", True), (None, "2027-04-10", 12, "2027-04-22", False), ("dow:2", "2027-06-02", 7, "2027-06-09", True), ("dow:2", "2027-06-02", 7, "2027-06-10", False), ("dom:20", "2027-01-20", 30, "2027-02-25", True), ("interval:45", "2027-03-01", 45, "2027-03-31", True), ("dom:20", None, 30, "2027-02-25", False), ("dom:31", "2027-01-31", 30, "2027-03-25", False)]
    rows = spark.createDataFrame([(i, a, x and d(x), p, d(y)) for i, (a, x, p, y, _) in enumerate(cases)], "i int, a string, due date, p int, day date")
    got = [r.r for r in rows.select("i", projection.covers(F.col("day"), F.col("due"), F.col("a"), F.col("p")).alias("r")).orderBy("i").collect()]
    assert got == [w for *_, w in cases]


def test_reimport_brings_nothing_new(spark):
    raw = spark.createDataFrame([("01/02/2025", "RENT", "-1000.00"), ("01/03/2025", "COFFEE", "-3.50"), ("x", "BAD", "1")], "Date string, Description string, Amount string")
    mapping = S.Mapping.load(S.suggest_mapping(raw.columns))
    rows = S.parse(raw, mapping).withColumn("account", F.lit(1))
    assert rows.count() == 2
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    stored = numbered.withColumnRenamed("row", "id").withColumn("settlement_status", F.lit("settled"))
    actions = dedup.classify(numbered, stored)
    assert {r.action for r in actions.collect()} == {"skip"}
    assert dedup.apply(numbered, stored, actions).count() == 2
    assert dedup.counts(dedup.classify(numbered, stored.limit(0))).first().imported == 2
    with pytest.raises(S.MappingError):
        S.Mapping.load({"layout": "split", "fields": {"date": "Date", "merchant": "Description"}})
    with pytest.raises(S.MappingError):
        mapping.resolve(["Date", "Amount"])


def test_equal_purchases_pair_one_to_one(spark):
    kind = "{} long, account long, date date, cents long, merchant string, imported_id string"
    rows = lambda number, given: spark.createDataFrame([(i, 1, d(x), c, m, k) for i, (x, c, m, k) in enumerate(given)], kind.format(number))
    coffee, later = ("2025-01-02", -350, "Coffee", None), ("2025-01-03", -350, "Coffee", None)
    settled = lambda given: rows("id", given).withColumn("settlement_status", F.lit("settled"))
    for n, m in ((3, 3), (3, 2), (2, 4)):
        actions = dedup.classify(rows("row", [coffee] * n), settled([coffee] * m)).collect()
        assert sorted(r.action for r in actions) == ["insert"] * max(0, n - m) + ["skip"] * min(n, m)
        assert len({r.stored_id for r in actions if r.action == "skip"}) == min(n, m)
    assert {r.action for r in dedup.classify(rows("row", [("2025-01-02", -350, "Coffee", "a")] * 2), settled([("2025-01-02", -350, "Coffee", "a")] * 2)).collect()} == {"skip"}
    # a candidate that loses its nearest row takes the next one
    assert {r.row: r.stored_id for r in dedup.classify(rows("row", [coffee, coffee, later]), settled([coffee, later, ("2025-01-04", -350, "Coffee", None)])).collect()} == {0: 0, 1: 2, 2: 1}
    # against pairs taken one by one
    rng = random.Random(5)
    some = lambda n: [(f"2025-01-{rng.randint(1, 9):02}", rng.choice([-1000, -1003, -990]), rng.choice(["Coffee", "Coffees", "Rent"]), None) for _ in range(n)]
    mine, theirs = some(60), some(40)
    near = lambda a, b: abs((d(a[0]) - d(b[0])).days) <= 3 and abs(a[1] - b[1]) <= abs(a[1]) * 5 // 1000 and (a[2] == b[2] or "Rent" not in (a[2], b[2]))
    first = lambda rows_, x: rows_.index(x)
    pairs = sorted(((3 if a[2] == b[2] else 4), abs((d(a[0]) - d(b[0])).days), abs(a[1] - b[1]), first(theirs, b), first(mine, a), i, j) for i, a in enumerate(mine) for j, b in enumerate(theirs) if near(a, b))
    want, used = {}, set()
    for number, *_, i, j in pairs:
        if i not in want and j not in used:
            want[i] = (number, j)
            used.add(j)
    got = dedup.classify(rows("row", mine), settled(theirs)).collect()
    assert len(got) == 60 and {r.row: (r["pass"], r.stored_id) for r in got if r.stored_id is not None} == want


def test_lifecycle(spark):
    edges = spark.createDataFrame([(e, *x) for e in (1, 2) for x in (("A", "B"), ("B", "C"), ("C", "D"), ("D", "E"), ("E", "F"), ("S", None))] + [(2, "F", "D"), (3, "S", "S"), (3, "T", "S"), (3, "U", "V")], "entity int, label string, input string")
    assert sorted(map(tuple, lifecycle.label_cycle_nodes(edges).collect())) == [*((2, x) for x in "ABCDEF"), (3, "S"), (3, "T")]
    assert lifecycle.label_cycle_nodes(edges.limit(0)).count() == 0
    jobs_ = spark.createDataFrame([("1", "e", "k", "queued", None, None, None)], "id string, entity_id string, job_type string, status string, started_at timestamp, completed_at timestamp, error string")
    assert lifecycle.create_job(jobs_, jobs_.withColumn("id", F.lit("2"))).count() == 1
    done = lifecycle.job_transition(jobs_, "1", "complete", F.current_timestamp())
    assert lifecycle.create_job(done, jobs_.withColumn("id", F.lit("2"))).count() == 2
    rows, cursor = pages.cut(list(range(3)), 3, [])
    assert rows == [0, 1, 2] and cursor is None


def test_jobs_are_worked_off_once(spark, tmp_path):
    (tmp_path / "inbox").mkdir()
    (tmp_path / "inbox" / "a.json").write_text('{"job_id":"1","entity_id":"e","job_type":"export.report"}\nnot json\n{"job_id":"2","entity_id":"e","job_type":"what"}\n')
    seen, bad = [], []
    for _ in range(2):
        handlers = {"export.report": lambda rows: seen.extend(r.job_id for r in rows.collect())}
        jobs.run_jobs(spark, str(tmp_path / "inbox"), str(tmp_path / "done"), handlers, lambda rows: bad.extend(r.raw for r in rows.collect())).awaitTermination()
    assert seen == ["1"] and len(bad) == 2


@pytest.mark.parametrize("name", ["A05_day_summary", "M19_W08_projection", "M02_first_pass", "A13_median"])
def test_queries_match_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("events", "orders", "customer", "nation"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    q = registry.QUERIES[name]
    frame = q.build(spark, sf)
    names = sorted(frame.columns)
    want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in names)} from ({q.sql})").fetchall()
    got = [tuple(r) for r in frame.select(*names).collect()]
    show = lambda rows: sorted(str(tuple(round(v, 4) if isinstance(v, float) else v for v in r)) for r in rows)
    assert show(got) == show(want) and len(got) > 0
    assert plans.FLAGSHIP is registry.QUERIES["A05_day_summary"].build


def test_rolling_streams(spark, tmp_path):
    """Sliding, tumbling and session totals of a stream against counting by hand; a repeat counts once."""
    from ratewright.streaming import rolling

    schema = "entry string, account long, imported_id string, ts timestamp, cents long"
    day = lambda n, h=0: dt.datetime(2025, 1, 1) + dt.timedelta(days=n, hours=h)
    rng = random.Random(41)
    data = [(rng.choice("ab"), 1, f"i{k}", day(rng.randint(0, 12), rng.randint(0, 23)), rng.randint(-50, 50)) for k in range(60)]
    spark.createDataFrame(data, schema).coalesce(1).write.json(str(tmp_path / "in"))
    flush = [("z", 1, "end", day(90), 0)]
    spark.createDataFrame(flush, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))

    def run(name, form):
        stream = form(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")))
        q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return [r for r in spark.table(name).collect() if "entry" not in r.asDict() or r.entry != "z"]

    sliding = {(r.entry, r.date): (r.total, r.n) for r in run("sliding", lambda s: rolling.sliding_totals(s, 3))}
    for n in range(13):
        x = day(n).date()
        for e in "ab":
            held = [c for f, _, _, t, c in data if f == e and 0 <= (x - t.date()).days <= 3]
            assert sliding.get((e, x)) == ((sum(held), len(held)) if held else None)
    buckets = {(r.entry, r.start): (r.total, r.n) for r in run("tumbling", rolling.tumbling)}
    assert buckets == {(e, day(n)): (sum(h), len(h)) for e in "ab" for n in range(13) if (h := [c for f, _, _, t, c in data if f == e and t.date() == day(n).date()])}
    sessions, want = sorted((r.entry, r.start, r.n) for r in run("sessions", lambda s: rolling.sessions(s, 1))), []
    for e in "ab":
        times = sorted(t for f, _, _, t, _ in data if f == e)
        start, n = times[0], 0
        for a, b in zip(times, [*times[1:], None]):
            n += 1
            if b is None or b - a > dt.timedelta(days=1):
                want.append((e, start, n))
                start, n = b, 0
    assert sessions == sorted(want)
    spark.createDataFrame(data[:20], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    once = run("once", rolling.without_repeats)
    assert sum(r.imported_id != "end" for r in once) == 60


def test_change_feed_tells_each_row_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id":1,"status":"queued"}\n{"id":2,"status":"complete"}\n')
    told = []
    for _ in range(2):
        jobs.watch_changes(spark, str(tmp_path / "in"), "id long, status string", str(tmp_path / "done"), "id", lambda rows: told.extend((r.id, r.payload) for r in rows.collect())).awaitTermination()
    assert sorted(told) == [(1, '{"id":1,"status":"queued"}'), (2, '{"id":2,"status":"complete"}')]


def test_settings(tmp_path):
    from ratewright.settings import Settings

    assert Settings.load(environment={}) == Settings() and Settings.load(str(tmp_path / "none.toml"), {}) == Settings()
    file = tmp_path / "s.toml"
    file.write_text('window_days = 30\ninbox = "in"\n')
    assert Settings.load(environment={"RATEWRIGHT_SETTINGS": str(file), "RATEWRIGHT_WINDOW_DAYS": "14"}) == Settings(inbox="in", window_days=14)
    for bad in ("unknown = 1\n", 'window_days = "x"\n'):
        file.write_text(bad)
        with pytest.raises(ValueError):
            Settings.load(str(file), {})


def test_mapping_suggestions():
    assert S.suggest_mapping(["Trans.  Date", "Narrative", "Amt", "Check Number"]) == {"layout": "signed", "fields": {"date": "Trans.  Date", "merchant": "Narrative", "imported_id": "Check Number", "amount": "Amt"}}
    assert S.suggest_mapping(["value date", "remarks", "Money Out", "Money In"])["layout"] == "split"
    assert S.suggest_mapping(["date", "payee", "sum", "CR/DR"])["fields"]["dc_indicator"] == "CR/DR"
    assert S.suggest_mapping(["a", "b"]) == {"layout": "signed", "fields": {}}


def test_previews(spark):
    rows = txns(spark, [("Kiosk", "2025-01-01", -5), ("Mill Water", "2025-01-02", -50), ("kiosk north", "2025-01-03", -500)])
    ids = lambda c, **more: [r.id for r in pages.preview(rows, c, **more).collect()]
    assert ids({"merchants": ["kiosk%", "x"]}) == [0, 2] and ids({"merchants": ["KIOSK"]}) == [0] and ids({"merchants": ["%"]}, limit=2) == [0, 1]
    assert ids({"merchants": []}) == ids({"merchants": "kiosk"}) == ids({}) == ids({"op": "NAND"}) == []
    assert ids({"type": "amount_range", "max_cents": -50}) == [1, 2]
