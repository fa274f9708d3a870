"""Queries on conditions, matching and de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratewright.functions import conditions as C
from ratewright.operators import dedup, lifecycle, match
from ratewright.registry import query
from ratewright.reports import pages, summary
from ratewright.sources import adapters as A

from . import sql as Q


def _payees(spark, sf):
    return A.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("merchant"))


def _fit(**leaf):
    return C.compile_tree(leaf)


@query(
    "P01_P07_payee_leaves",
    """select p_partkey as id, case when lower(p_name) = 'red widget' then 1.0::double end as exact, case when contains(lower(p_name), 'ring') then least(1.0, 0.75 + 0.15 * (4 / greatest(strlen(p_name), 1))) end as contained,
      case when not contains(lower(p_name), 'gear') then 1.0::double end as without, case when starts_with(lower(p_name), 'small') then least(1.0, 0.85 + 0.15 * (5 / greatest(strlen(p_name), 1))) end as starts,
      case when ends_with(lower(p_name), 'bolt') then least(1.0, 0.85 + 0.15 * (4 / greatest(strlen(p_name), 1))) end as ends, case when regexp_matches(p_name, '^(red|hot) ') then 1.0::double end as pattern,
      case when lower(p_name) in ('red widget', 'hot gear') then 1.0::double end as one_of from part""",
)
def _p01(spark, sf):
    return _payees(spark, sf).select(
        "id", _fit(type="payee_exact", value="RED widget").alias("exact"), _fit(type="imported_payee_contains", value="RING").alias("contained"), _fit(type="payee_not_contains", value="gear").alias("without"),
        _fit(type="payee_starts_with", value="Small").alias("starts"), _fit(type="payee_ends_with", value="bolt").alias("ends"), _fit(type="payee_regex", value="^(red|hot) ").alias("pattern"),
        _fit(type="imported_payee_one_of", value=["Red Widget", "hot gear"]).alias("one_of"),
    )


@query(
    "P08_P15_amount_and_time_leaves",
    Q.T + """, d as (select id, cents, date, day(date) as dom, day(last_day(date)) as dim, account from txn)
    select id, case when cents between -5000 and -1000 then 1.0::double end as amount, case when cents >= -2000 then 1.0::double end as at_least, case when abs(dom - 15) <= 2 then 1.0::double end as dom15,
      case when date between '2024-01-05' and '2024-01-20' then 1.0::double end as in_range, case when account = 7 then 1.0::double end as mine, case when account % 3 = 1 then 1.0::double end as bank,
      case when abs(dom - 15) < 5 then 1.0::double end as anchor15, case when abs(dom - 1) < 5 or abs(dom - dim) < 5 then 1.0::double end as anchor_ends, case when isodow(date) - 1 = 4 then 1.0::double end as friday, cast(null as double) as interval_row from d""",
)
def _p08(spark, sf):
    t = A.transactions(spark, sf).withColumn("institution", F.col("account") % 3)
    return t.select(
        "id", _fit(type="amount_range", min_cents=-5000, max_cents=-1000).alias("amount"), _fit(type="amount_range", min_cents=-2000).alias("at_least"), _fit(type="date_day_of_month", day=15, tolerance_days=2).alias("dom15"),
        _fit(type="date_range", start="2024-01-05", end="2024-01-20").alias("in_range"), _fit(type="account", value=7).alias("mine"), _fit(type="institution_id", value=1).alias("bank"),
        _fit(type="recurrence_anchor", recurrence_anchor="dom:15").alias("anchor15"), _fit(type="recurrence_anchor", recurrence_anchor="dom:1,-1").alias("anchor_ends"),
        _fit(type="recurrence_anchor", recurrence_anchor="dow:4").alias("friday"), _fit(type="recurrence_anchor", recurrence_anchor="interval:7").alias("interval_row"),
    )


def _struct(entry, label, direction, kind, period, source, overall, merchant, rate, anchor):
    values = (entry, label, direction, kind, period, source, overall, merchant, None, None, rate, anchor)
    return F.struct(*(F.lit(v) for v in values))


@query(
    "P16_P23_entry_leaves",
    Q.T + """, g as (select id, cents, id % 3 as g from txn)
    select id, case when g = 1 then 1.0::double end as rent, case g when 2 then null when 1 then case when cents <= 0 then 1.0::double end else case when cents < 0 then 1.0::double end end as spend, case g when 0 then 1.0::double when 1 then case when cents > 0 then 1.0::double end else 1.0 end as mixed,
      case when g > 0 then 1.0::double end as standing, case when g = 1 then 1.0::double end as monthly, case when g = 2 then 1.0::double end as engine, case when g = 1 then 1.0::double end as fit, case when g = 1 then 1.0::double end as rate, case when g = 1 then 1.0::double end as first from g""",
)
def _p16(spark, sf):
    rent = _struct("a", "rent", "spend", "standing", 30, "user", 0.9, 0.85, -55.5, "dom:1")
    both = [_struct("b", "food", "spend", "variable", None, "engine", 0.9, 0.5, None, None), _struct("c", "pay", "income", "standing", 14, "engine", 0.5, 0.9, 100.0, None)]
    group = F.col("id") % 3
    held = F.when(group == 1, F.array(rent).cast(C.MATCHED)).when(group == 2, F.array(*(b.cast(C.MATCHED[6:-1]) for b in both))).otherwise(F.array().cast(C.MATCHED))
    t = A.transactions(spark, sf).withColumn("matched", held).withColumn("labels", F.transform("matched", lambda m: m["label"]))
    return t.select(
        "id", _fit(type="label_matched", label_id="rent").alias("rent"), _fit(type="entry_direction", direction="spend").alias("spend"), _fit(type="entry_direction", direction="mixed").alias("mixed"),
        _fit(type="entry_type", entry_type="standing").alias("standing"), _fit(type="entry_period", min_days=28, max_days=31).alias("monthly"), _fit(type="entry_source", source="engine").alias("engine"),
        _fit(type="entry_fitness", score={"overall": {"min": 0.8}, "merchant": {"min": 0.8}}).alias("fit"), _fit(type="entry_projected_rate", max=-1).alias("rate"), _fit(type="entry_recurrence_anchor", recurrence_anchor="dom:1").alias("first"),
    )


@query(
    "P24_P27_boolean_nodes",
    """with f as (select p_partkey as id, case when contains(lower(p_name), 'ring') then least(1.0, 0.75 + 0.15 * (4 / strlen(p_name))) end as a, case when starts_with(lower(p_name), 'small') then least(1.0, 0.85 + 0.15 * (5 / strlen(p_name))) end as b from part)
    select id, case when a is not null and b is not null then least(a, b) end as both, case when a is null then b when b is null then a else greatest(a, b) end as either, case when a is null then 1.0::double end as neither, case when a is null then b when b is null then a end as one, 1.0::double as always from f""",
)
def _p24(spark, sf):
    a, b = {"type": "payee_contains", "value": "ring"}, {"type": "payee_starts_with", "value": "small"}
    node = lambda op, *children: C.compile_tree({"op": op, "children": list(children)})
    return _payees(spark, sf).select("id", node("AND", a, b).alias("both"), node("OR", a, b).alias("either"), node("NOT", a).alias("neither"), node("XOR", a, b).alias("one"), node("AND").alias("always"))


def _entry_trees(spark, sf):
    return A.transactions(spark, sf).withColumn("institution", F.lit(None).cast("bigint"))


_FIRST = [
    match.Entry("buy", {"op": "AND", "children": [{"type": "payee_exact", "value": "purchase"}, {"type": "amount_range", "max_cents": -2000}]}, label="shopping"),
    match.Entry("early", {"op": "AND", "children": [{"type": "payee_contains", "value": "ic"}, {"type": "recurrence_anchor", "recurrence_anchor": "dom:3"}]}, label="clicks"),
    match.Entry("pay", {"op": "AND", "children": [{"type": "payee_starts_with", "value": "sign"}, {"op": "NOT", "children": [{"type": "amount_range", "min_cents": 10000}]}]}, direction="income", label="pay"),
    match.Entry("broken", {"op": "NAND", "children": []}),
]
_FIRST_SQL = """, t as (select *, day(date) as dom from txn),
first_ as (select id, 'buy' as entry, 1.0::double as fit from t where merchant = 'purchase' and cents <= -2000 union all select id, 'early', least(1.0, 0.75 + 0.15 * (2 / 5)) from t where merchant = 'click' and abs(dom - 3) < 5
  union all select id, 'pay', least(1.0, 0.85 + 0.15 * (4 / 6)) from t where merchant = 'signup' and cents < 10000)"""


@query("M02_first_pass", Q.T + _FIRST_SQL + " select id, entry, fit from first_")
def _m02(spark, sf):
    return match.first_pass(_entry_trees(spark, sf), _FIRST)


@query(
    "M03_J12_interval_chain",
    Q.O + """, d as (select distinct entry, date from ord), linked as (select a.entry, a.date as x, b.date as y from d a join d b on a.entry = b.entry and date_diff('day', a.date, b.date) between 87 and 95)
    select id, entry from ord semi join (select entry, x as date from linked union all select entry, y from linked) l using (entry, date)""",
)
def _m03(spark, sf):
    return match.interval_chain(A.orders(spark, sf).withColumn("every", F.lit(91))).select("id", "entry")


_SECOND = [
    match.Entry("outgo", {"type": "entry_direction", "direction": "spend"}, 200, "money"),
    match.Entry("again", {"type": "label_matched", "label_id": "shopping"}, 210, "money"),
    match.Entry("group", {"op": "OR", "children": [{"type": "label_matched", "label_id": "pay"}, {"type": "label_matched", "label_id": "money"}]}, 300, "all"),
]


_SECOND_SQL = """, held as (select t.id, t.cents, list(f.entry) as e from t left join first_ f on f.id = t.id group by t.id, t.cents),
    base as (select id, coalesce(list_contains(e, 'buy'), false) as buy, coalesce(list_contains(e, 'pay'), false) as pay, coalesce(list_contains(e, 'early'), false) as early,
      (cents < 0 or buy or early) and not (cents > 0 or pay) as spends from held)
    select id, entry, fit from first_
    union all select id, 'outgo', 1.0::double from base where spends
    union all select id, 'again', 1.0::double from base where buy
    union all select id, 'group', 1.0::double from base where pay or spends"""


@query("M04_second_pass", Q.T + _FIRST_SQL + _SECOND_SQL)
def _m04(spark, sf):
    t = _entry_trees(spark, sf)
    return match.second_pass(t, match.first_pass(t, _FIRST), _FIRST[:3], _SECOND)


def _imports(spark, sf):
    """Stored rows: even orders; candidates: three in four orders anew (the others are not imported again), dates and amounts shifted a little, one in five with its id."""
    o = A.orders(spark, sf).withColumn("account", F.col("entry"))
    stored = o.filter("id % 2 = 0").select("id", "account", "date", "cents", "merchant", F.expr("case when id % 10 = 0 then cast(id as string) end").alias("imported_id"), F.expr("case when date < date'2001-01-01' then 'settled' else 'flux' end").alias("settlement_status"))
    candidates = o.filter("id % 4 < 3").select(F.col("id").alias("row"), "account", F.expr("date_add(date, cast(id % 3 as int))").alias("date"), F.expr("cents + id % 5").alias("cents"), "merchant", F.expr("case when id % 5 = 0 then cast(id as string) end").alias("imported_id"))
    return candidates, stored


@query("M01_J10_J11_dedup")
def _m01(spark, sf):
    candidates, stored = _imports(spark, sf)
    return dedup.classify(candidates, stored)


@query(
    "M01_exact_and_boundary",
    Q.O + """, stored as (select id, entry as account, date, case when id % 10 = 0 then cast(id as varchar) end as imported_id from ord where id % 2 = 0),
    cand as (select id as row, entry as account, date + cast(id % 3 as integer) as date, case when id % 5 = 0 then cast(id as varchar) end as imported_id from ord where id % 4 < 3),
    b as (select account, max(date) as boundary from stored group by account)
    select c.row, case when s.id is not null then 1 else 2 end as pass from cand c left join stored s using (account, imported_id) left join b using (account)
    where s.id is not null or boundary is null or c.date > boundary + 3""",
)
def _m01b(spark, sf):
    candidates, stored = _imports(spark, sf)
    return dedup.classify(candidates, stored).filter("pass in (1, 2)").select("row", "pass")


@query(
    "J10_band_join",
    Q.O + """ select a.id as row, b.id as stored_id from ord a join ord b on a.entry = b.entry and a.merchant = b.merchant and abs(date_diff('day', a.date, b.date)) <= 30 and abs(a.cents - b.cents) <= floor(abs(a.cents) * 0.5) and a.id <> b.id""",
)
def _j10(spark, sf):
    o = A.orders(spark, sf)
    stored = o.withColumn("settlement_status", F.lit("flux"))
    pairs = dedup._band_join(o.withColumnRenamed("id", "row"), stored, ["entry", "merchant"], 30, 0.5)
    return pairs.filter("row <> s_id").select("row", F.col("s_id").alias("stored_id"))


@query("K01_K05_import")
def _k01(spark, sf):
    candidates, stored = _imports(spark, sf)
    actions = dedup.classify(candidates, stored)
    after = dedup.apply(candidates, stored, actions)
    return dedup.counts(actions).crossJoin(F.broadcast(after.agg(F.count("*").alias("stored"))))


@query("P30_P34_filters", Q.T + """, m as (select max(date) as d from txn) select id, date, cents from txn, m where merchant ilike '%CLI%' and date >= d - 10 and account = 3 or (date, id) < (date '2024-01-02', 40)""")
def _p30(spark, sf):
    t = A.transactions(spark, sf)
    latest = F.broadcast(t.agg(F.max("date").alias("d")))
    keep = (F.col("merchant").ilike("%CLI%") & (F.col("date") >= F.date_sub("d", 10)) & (F.col("account") == 3)) | F.expr("date < date'2024-01-02' or (date = date'2024-01-02' and id < 40)")
    return t.crossJoin(latest).filter(keep).select("id", "date", "cents")


@query("P31_like_any", Q.T + " select id from txn where merchant ilike 'CLI%' or merchant ilike '%new' or merchant ilike 'nothing'")
def _p31(spark, sf):
    return A.transactions(spark, sf).filter(pages.matching_any("merchant", ["CLI%", "%new", "nothing"])).select("id")


@query("M24_condition_preview", Q.T + " select id from txn where starts_with(merchant, 'c') and cents < -1000 order by id limit 200")
def _m24(spark, sf):
    tree = {"op": "AND", "children": [{"type": "payee_starts_with", "value": "C"}, {"type": "amount_range", "max_cents": -1001}]}
    return pages.preview(A.transactions(spark, sf), tree)


@query("P32_optional_filters", Q.T + " select id from txn where account = 5 and merchant in ('click', 'view')")
def _p32(spark, sf):
    return pages.filtered(A.transactions(spark, sf), account=5, merchant=["click", "view"], date=None).select("id")


_JOBS_SQL = """, job as (select event_id as id, ['import.process', 'export.report', 'account.analyze', 'balance.project'][event_id % 4 + 1] as job_type, ['queued', 'complete', 'processing'][event_id % 3 + 1] as status from events)"""


def _jobs(spark, sf):
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), (F.col("event_id") % n).cast("int"))
    kinds, states = ["import.process", "export.report", "account.analyze", "balance.project"], ["queued", "complete", "processing"]
    return A.table(spark, sf, "events").select(F.col("event_id").alias("id"), pick(kinds, 4).alias("job_type"), pick(states, 3).alias("status"))


@query("P35_P36_without_active_jobs", Q.T + _JOBS_SQL + " select id, entry from txn where id not in (select id from job where status <> 'complete' and job_type in ('import.process', 'account.analyze'))")
def _p35(spark, sf):
    active = lifecycle.active_snapshot_jobs(_jobs(spark, sf))
    return summary.without_active_jobs(A.transactions(spark, sf).withColumn("job_id", F.col("id")), active).select("id", "entry")


@query("P36_active_jobs", Q.T + _JOBS_SQL + " select id, job_type, status from job where status in ('queued', 'processing')")
def _p36(spark, sf):
    return lifecycle.active_jobs(_jobs(spark, sf))


@query("P28_broken_trees", Q.T + " select distinct entity || ':' || e as entry, e = 'a' as sound from txn, (values ('a'), ('b'), ('c')) v(e)")
def _p28(spark, sf):
    """Each entity's three entries from a table of JSON trees; two of them cannot be compiled."""
    trees = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(t).alias("conditions")) for k, t in (("a", '{"type":"payee_exact","value":"view"}'), ("b", '{"op":"NAND"}'), ("c", '{"type":"payee_regex","value":"("}'))))
    entities = A.transactions(spark, sf).select("entity").distinct().withColumn("t", F.explode(trees))
    rows = entities.select("entity", F.concat_ws(":", F.col("entity").cast("string"), "t.k").alias("entry"), F.lit(100).alias("priority"), F.lit(None).cast("string").alias("label"), "t.conditions", F.lit(None).cast(C.MATCHED[6:-1]).alias("facts"))
    return match.compile_table(rows).select("entry", F.col("error").isNull().alias("sound"))


@query("M02_entries_as_table", Q.T + " select id, entity || ':' || merchant as entry, 1.0::double as fit from txn where cents between -100 * (entity + 1) * 20 and 100000")
def _m02_table(spark, sf):
    """An entry per entity and merchant, each with its own name and least amount, from a table of JSON trees."""
    t = A.transactions(spark, sf)
    tree = F.concat(F.lit('{"op":"AND","children":[{"type":"payee_exact","value":"'), "merchant", F.lit('"},{"type":"amount_range","max_cents":100000,"min_cents":'), (-2000 * (F.col("entity") + 1)).cast("string"), F.lit("}]}"))
    rows = t.select("entity", "merchant", "entry").distinct().select("entity", "entry", F.lit(100).alias("priority"), F.lit(None).cast("string").alias("label"), tree.alias("conditions"), F.lit(None).cast(C.MATCHED[6:-1]).alias("facts"))
    return match.first_pass(t, match.compile_table(rows))


_INDEX_SQL = Q.O + """, c as (select c_custkey as k, c_custkey % 3 as kind from customer)
    select id, 'r' || k as entry, 1.0::double as fit from ord join c on kind = 0 and cents between -20000 * k - 4000 and -20000 * k
    union all select id, 'a' || k, case when starts_with(merchant, 'Harbour') then least(1.0, 0.85 + 0.15 * (7 / length(merchant))) end from ord join c on kind = 1 and entry = k and starts_with(merchant, 'Harbour')
    union all select id, 'd' || k, 1.0::double from ord join c on kind = 2 and (date between date '1992-01-01' + cast(k as integer) and date '1992-01-03' + cast(k as integer) or (merchant = 'Ridge View' and entry = k))"""


@query("J13_entry_index", _INDEX_SQL)
def _j13(spark, sf):
    """An entry per customer, all of one entity: by a range of amounts, by name and account, by days or name and account."""
    k = F.col("c_custkey")
    leaf = lambda kind, **v: F.struct(F.lit(kind).alias("type"), *(x.alias(n) for n, x in v.items()))
    amounts = F.to_json(leaf("amount_range", min_cents=-20000 * k - 4000, max_cents=-20000 * k))
    name, other = F.to_json(leaf("payee_starts_with", value=F.lit("harbour"))), F.to_json(leaf("payee_exact", value=F.lit("ridge view")))
    account = F.to_json(leaf("account_id", value=k.cast("string")))
    day = lambda n: F.date_add(F.lit("1992-01-01").cast("date"), (k + n).cast("int")).cast("string")
    days = F.to_json(leaf("date_range", start=day(0), end=day(2)))
    both = lambda op, *parts: F.concat(F.lit(f'{{"op":"{op}","children":['), F.concat_ws(",", *parts), F.lit("]}"))
    kind = (k % 3).cast("int")
    conditions = F.when(kind == 0, amounts).when(kind == 1, both("AND", name, account)).otherwise(both("OR", days, both("AND", other, account)))
    entries = A.table(spark, sf, "customer").select(F.lit("all").alias("entity"), F.concat(F.get(F.array(*map(F.lit, "rad")), kind), k.cast("string")).alias("entry"), F.lit(100).alias("priority"), F.lit(None).cast("string").alias("label"), conditions.alias("conditions"), F.lit(None).cast(C.MATCHED[6:-1]).alias("facts"))
    orders = A.orders(spark, sf).withColumn("account", F.col("entry")).withColumn("institution", F.lit(None).cast("string")).withColumn("entity", F.lit("all")).drop("entry", "label")
    return match.first_pass(orders, match.compile_table(entries))
