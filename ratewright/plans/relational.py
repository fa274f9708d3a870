"""Queries on joins, aggregates, set operations, sorting and paging (J, A, U, L)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ratewright.functions.money import grouped_median
from ratewright.operators import lifecycle, match, proposals
from ratewright.operators import rates as ops
from ratewright.registry import query
from ratewright.reports import pages, summary
from ratewright.sources import adapters as A

from . import sql as Q
from .rates import rates


def _t(spark, sf):
    return A.transactions(spark, sf)


def _e(spark, sf):
    return A.entries(_t(spark, sf))


@query("J01_inner", Q.RATES + " select r.entry, r.date, r.actual, e.entry_type from rates r join entries e using (entry) where e.status = 'live'")
def _j01(spark, sf):
    return rates(spark, sf).join(_e(spark, sf).filter("status = 'live'").select("entry", "entry_type"), "entry").select("entry", "date", "actual", "entry_type")


@query("J02_three_way_range", Q.TE + " select t.id, e.entry, t.cents from txn t join entries e using (entry) join customer c on c.c_custkey = t.account where t.date between e.start_date and date '2024-01-15'")
def _j02(spark, sf):
    c = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("account"))
    joined = _t(spark, sf).filter("date <= date'2024-01-15'").join(_e(spark, sf).select("entry", "start_date"), "entry").join(c, "account")
    return joined.filter("date >= start_date").select("id", "entry", "cents")


@query("J03_left", Q.A + " select id, t.account, institution from txn t left join accounts a on a.account = t.account + 100")
def _j03(spark, sf):
    a = A.accounts(spark, sf).select((F.col("account") - 100).alias("account"), "institution")
    return _t(spark, sf).join(a, "account", "left").select("id", "account", "institution")


@query("J04_A09_left_chain_group", Q.O + " select c_custkey, count(o.id) as n, avg(case when cents < 0 then 0.5 else 1.0 end) filter (o.id is not null) as fit from customer left join ord o on o.entry = c_custkey group by c_custkey")
def _j04(spark, sf):
    o = A.orders(spark, sf).groupBy("entry").agg(F.count("*").alias("n"), F.avg(F.when(F.col("cents") < 0, 0.5).otherwise(1.0)).alias("fit"))
    c = A.table(spark, sf, "customer")
    return c.join(o, c.c_custkey == o.entry, "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), "fit")


_LATEST = "row_number() over (partition by entry order by date desc) = 1"


@query("J05_W06_latest", Q.RATES + f" select e.entry, e.label, s.date, s.actual from entries e left join (select * from rates qualify {_LATEST}) s using (entry)")
def _j05(spark, sf):
    return _e(spark, sf).select("entry", "label").join(summary.latest_per_entry(rates(spark, sf)), "entry", "left").select("entry", "label", "date", "actual")


@query("J06_as_of", Q.RATES + f" select entry, date, actual from (select * from rates where date <= date '2024-01-12') qualify {_LATEST}")
def _j06(spark, sf):
    return summary.latest_per_entry(rates(spark, sf), F.lit("2024-01-12").cast("date")).select("entry", "date", "actual")


@query("J07_J08_J20_semi_anti", Q.T + " select id, true as used from txn where exists (select 1 from customer where c_custkey = account and c_mktsegment = 'MACHINERY') union all select id, false from txn where not exists (select 1 from customer where c_custkey = account and c_mktsegment = 'MACHINERY')")
def _j07(spark, sf):
    c = A.table(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("account"))
    t = _t(spark, sf)
    return t.join(c, "account", "left_semi").select("id", F.lit(True).alias("used")).unionByName(t.join(c, "account", "left_anti").select("id", F.lit(False).alias("used")))


@query("J09_prune_unassigned", Q.TE + " select entry from entries where status <> 'pending' or exists (select 1 from txn t where t.entry = entries.entry and cents < -20000)")
def _j09(spark, sf):
    e = _e(spark, sf).withColumn("source", F.lit("engine"))
    gone = proposals.unbacked(e, _t(spark, sf).filter("cents < -20000").select("entry").distinct())
    return e.join(gone, "entry", "left_anti").select("entry")


@query("J14_cross", "select r_name as role, n_name as permission from region, nation")
def _j14(spark, sf):
    roles = A.table(spark, sf, "region").select(F.col("r_name").alias("role"))
    return roles.crossJoin(A.table(spark, sf, "nation").select(F.col("n_name").alias("permission")))  # tens of fixed rows on both sides


@query("J15_calendar", Q.RATES.rsplit(",\ndaily as", 1)[0] + " select entry, date from grid")
def _j15(spark, sf):
    return ops.grid(_e(spark, sf).crossJoin(F.broadcast(ops.as_of(_t(spark, sf)))), F.col("as_of")).select("entry", "date")


@query("J17_A10_start_sync", Q.TE + ", s as (select entry, min(date) as d from txn where cents < -1000 group by entry) select entry, least(start_date + 3, coalesce(d, start_date + 3)) as start_date from entries left join s using (entry)")
def _j17(spark, sf):
    later = _e(spark, sf).withColumn("start_date", F.date_add("start_date", 3))
    return proposals.pulled_back(later, _t(spark, sf).filter("cents < -1000").select("entry", "date")).select("entry", "start_date")


@query("J18_A04_balances", Q.A + " select a.account, cast(starting + coalesce((select sum(cents) from txn t where t.account = a.account), 0) as bigint) as balance from accounts a")
def _j18(spark, sf):
    return lifecycle.recalculated_balances(A.accounts(spark, sf), _t(spark, sf)).select("account", "balance")


@query("J19_A06_latest_summary", Q.RATES + """, d as (select max(date) as d from rates)
    select entity, date, round(sum(case when direction = 'income' then actual else 0.0 end), 4) as income, round(sum(case when direction = 'spend' then actual else 0.0 end), 4) as spend,
      round(round(sum(case when direction = 'income' then actual else 0.0 end), 4) + round(sum(case when direction = 'spend' then actual else 0.0 end), 4), 4) as margin, round(sum(drift), 4) as drift from rates, d where date = d group by entity, date""")
def _j19(spark, sf):
    return summary.latest_summary(rates(spark, sf), "entity")


@query("J21_names", "select c_name, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where lower(n_name) = 'nation_3'")
def _j21(spark, sf):
    n = A.table(spark, sf, "nation").filter(F.lower("n_name") == "nation_3")
    r = A.table(spark, sf, "region")
    named = n.join(r, n.n_regionkey == r.r_regionkey)
    return A.table(spark, sf, "customer").join(named, F.col("c_nationkey") == F.col("n_nationkey")).select("c_name", "n_name", "r_name")


@query("J22_role_permissions", "select r_name, n_name, c_mktsegment, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all")
def _j22(spark, sf):
    n, r = A.table(spark, sf, "nation"), A.table(spark, sf, "region")
    per = A.table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return per.join(n, per.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name", "n_name", "c_mktsegment").agg(F.sum("n").alias("n"))


@query("A01_A02_global", Q.TE + " select min(start_date) as history_start, (select max(date) from txn) as as_of, count(*) filter (status = 'pending') as pending, count(*) filter (status = 'live') as live, count(*) filter (end_date is not null) as closed from entries")
def _a01(spark, sf):
    counts = _e(spark, sf).agg(F.min("start_date").alias("history_start"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "live").alias("live"), F.count("end_date").alias("closed"))
    return counts.crossJoin(F.broadcast(_t(spark, sf).agg(F.max("date").alias("as_of"))))


@query("A03_A25_distinct_counts", Q.T + " select merchant, count(distinct account) as accounts, count(distinct case when cents < -10000 then account end) as large, count(*) as n from txn group by merchant")
def _a03(spark, sf):
    per = _t(spark, sf).groupBy("merchant", "account").agg(F.count("*").alias("n"), F.some(F.col("cents") < -10000).alias("large"))
    return per.groupBy("merchant").agg(F.count("*").alias("accounts"), F.count_if("large").alias("large"), F.sum("n").alias("n"))


_SUMMARY = """ select date, round(sum(case when direction = 'income' then actual else 0.0 end), 4) as income, round(sum(case when direction = 'spend' then actual else 0.0 end), 4) as spend,
  round(round(sum(case when direction = 'income' then actual else 0.0 end), 4) + round(sum(case when direction = 'spend' then actual else 0.0 end), 4), 4) as margin, round(sum(drift), 4) as drift from rates group by date"""


@query("A05_day_summary", Q.RATES + _SUMMARY)
def _a05(spark, sf):
    return summary.day_summary(rates(spark, sf))


@query("A07_K06_report", Q.RATES + f""", s as ({_SUMMARY})
    select strftime(date, '%Y-%m-%d') as "Date", printf('%.2f', round(income / 100 * 30.44, 2)) as "Income/mo", printf('%.2f', round(spend / 100 * 30.44, 2)) as "Spend/mo", printf('%.2f', round(margin / 100 * 30.44, 2)) as "Margin/mo", printf('%.2f', round(drift / 100 * 30.44, 2)) as "Drift/mo" from s""")
def _a07(spark, sf):
    return summary.report(summary.day_summary(rates(spark, sf)), "month")


@query("A08_T10_buckets", Q.RATES + " select entry, cast(date_trunc('week', date) as date) as bucket, arg_min(actual, date) as open, max(actual) as high, min(actual) as low, arg_max(actual, date) as close, round(avg(actual), 4) as mean from rates group by 1, 2")
def _a08(spark, sf):
    return summary.buckets(rates(spark, sf), "week")


@query("A11_A14_extremes", Q.T + " select entry, max(date) as last, max(abs(cents)) as largest from txn group by entry")
def _a11(spark, sf):
    return _t(spark, sf).groupBy("entry").agg(F.max("date").alias("last"), F.max(F.abs("cents")).alias("largest"))


@query("A13_median", Q.O + ", s as (select entry, list_sort(list(cents)) as a from ord group by entry) select entry, cast((a[(len(a) + 1) // 2] + a[len(a) // 2 + 1]) // 2 as bigint) as median from s")
def _a13(spark, sf):
    return grouped_median(A.orders(spark, sf), ["entry"], "cents", "median")


@query("A15_regression", Q.RATES + " select entry, round(case when count(*) >= 2 then regr_slope(actual, date_diff('day', date '1970-01-01', date)) else 0.0 end, 6) as slope, round(case when count(*) >= 2 then regr_r2(actual, date_diff('day', date '1970-01-01', date)) else 0.0 end, 3) as r_squared from rates group by entry")
def _a15(spark, sf):
    return ops.regression(rates(spark, sf), "entry", "actual")


@query("A20_word_frequency", "with w as (select unnest(string_split(lower(p_name), ' ')) as word from part) select word, count(*) as df from w group by word having count(*) >= 2")
def _a20(spark, sf):
    words = A.table(spark, sf, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("df")).filter("df >= 2")


@query("A21_A22_samples", Q.T + ", d as (select distinct merchant, account from txn), r as (select *, row_number() over (partition by merchant order by account) as k from d) select merchant, array_to_string(list_sort(list(account)), ',') as accounts from r where k <= 5 group by merchant")
def _a21(spark, sf):
    first = Window.partitionBy("merchant").orderBy("account")
    d = _t(spark, sf).select("merchant", "account").distinct().withColumn("k", F.row_number().over(first)).filter("k <= 5")
    return d.groupBy("merchant").agg(F.array_join(F.array_sort(F.collect_list("account")).cast("array<string>"), ",").alias("accounts"))


_STACK = """, s as (select * from rates qualify row_number() over (partition by entry order by date desc) = 1),
e as (select entry, case when label = 'error' then null else label end as label from entries)
select coalesce(e.label, '__null__') as label, round(sum(coalesce(actual, projected, 0.0)), 4) as rate, count(*) as entries, round(sum(coalesce(drift, 0.0)), 4) as drift from e left join s using (entry) group by e.label"""


@query("A23_A26_M23_stack", Q.RATES + _STACK)
def _a23(spark, sf):
    e = _e(spark, sf).select("entry", F.nullif("label", F.lit("error")).alias("label"))
    return summary.budget_stack(e, summary.latest_per_entry(rates(spark, sf)))


@query("U01_U04_sets", Q.T + " select entry, date from txn where merchant = 'click' union select entry, date from txn where account < 50 except select entry, date from txn where cents < -20000")
def _u01(spark, sf):
    t = _t(spark, sf)
    pairs = lambda rows: rows.select("entry", "date")
    return pairs(t.filter("merchant = 'click'")).unionByName(pairs(t.filter("account < 50"))).distinct().join(pairs(t.filter("cents < -20000")).distinct(), ["entry", "date"], "left_anti")


@query("L01_L02_page", Q.O + " select id, date, cents from ord where (date, id) < (date '1999-06-01', 5000) order by date desc, id desc limit 51")
def _l01(spark, sf):
    import datetime as dt

    return pages.page(A.orders(spark, sf).select("id", "date", "cents"), [("date", True), ("id", True)], 50, [dt.date(1999, 6, 1), 5000])


@query("L03_L07_ranks", Q.TE + " select entry, cast(row_number() over (partition by entity order by case status when 'pending' then 0 when 'live' then 1 else 2 end, label = 'signup' desc, period_days desc nulls last, coalesce(label, ''), entry) as bigint) as place from entries")
def _l03(spark, sf):
    rank = F.when(F.col("status") == "pending", 0).when(F.col("status") == "live", 1).otherwise(2)
    order = [rank, (F.col("label") == "signup").desc(), F.col("period_days").desc_nulls_last(), F.coalesce("label", F.lit("")), F.col("entry")]
    return pages.ranked(_e(spark, sf), ["entity"], order).select("entry", "place")


_SYSTEM = " select entry, cast(row_number() over (partition by entity order by case name when 'All' then 0 when 'Income' then 1 when 'Spend' then 2 else 4 end, entry) as bigint) as place from (select *, case label when 'signup' then 'Income' when 'purchase' then 'Spend' when 'view' then 'All' else label end as name from entries)"


@query("L04_system_order", Q.TE + _SYSTEM)
def _l04(spark, sf):
    name = F.when(F.col("label") == "signup", "Income").when(F.col("label") == "purchase", "Spend").when(F.col("label") == "view", "All").otherwise(F.col("label"))
    return pages.ranked(_e(spark, sf).withColumn("name", name), ["entity"], [pages.system_place(F.col("name")), F.col("entry")]).select("entry", "place")


@query("L08_frequent_merchants", Q.O + " select merchant, count(*) as n from ord group by merchant order by n desc, merchant limit 50")
def _l08(spark, sf):
    return pages.frequent_merchants(A.orders(spark, sf))


@query("L09_ascending_page", Q.RATES + " select entry, date, projected from rates order by date, entry limit 20")
def _l09(spark, sf):
    return rates(spark, sf).select("entry", "date", "projected").orderBy("date", "entry").limit(20)


@query("W06_latest_rows", Q.O + " select entry, id, date from ord qualify row_number() over (partition by entry order by date desc, id desc) = 1")
def _w06(spark, sf):
    return match.latest(A.orders(spark, sf).withColumn("key", F.struct("date", "id")), ["entry"], "key").select("entry", "id", "date")
