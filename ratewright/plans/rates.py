"""Queries on rates, trends, snapshots, detection and projection (W, M05-M24)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ratewright.functions import dates as D
from ratewright.operators import cluster, lifecycle, projection
from ratewright.operators import rates as ops
from ratewright.registry import query
from ratewright.reports import summary
from ratewright.sources import adapters as A

from . import sql as Q

def _both(spark, sf):
    txns = A.transactions(spark, sf)
    return txns, A.entries(txns)


def rates(spark, sf):
    """Rates of the adapter's entries with the window of the registered queries."""
    return ops.entry_rates(*_both(spark, sf), Q.WINDOW)


@query("W01_W02_M12_entry_rates", Q.RATES + " select entry, date, count, days, total, actual, projected, drift from rates")
def _w01(spark, sf):
    return rates(spark, sf).select("entry", "date", "count", "days", "total", "actual", "projected", "drift")


@query("W01_window_per_entry", Q.RATES.rsplit(",\nusual as", 1)[0] + """ select g.entry, g.date, cast(coalesce(sum(d.cents), 0) as bigint) as total, cast(coalesce(sum(d.n), 0) as bigint) as count
    from grid g left join daily d on d.entry = g.entry and d.date between g.date - cast(g.period_days as integer) and g.date group by g.entry, g.date""")
def _w01b(spark, sf):
    txns, entries = _both(spark, sf)
    days = ops.grid(entries.crossJoin(F.broadcast(ops.as_of(txns))), F.col("as_of")).join(ops.daily(txns), ["entry", "date"], "left")
    return ops.rolling_by_entry(days, "period_days").select("entry", "date", "total", "count")


@query("W03_expanding_median", Q.RATES.rsplit(",\nfilled as", 1)[0] + " select entry, date, cast((a[(len(a) + 1) // 2] + a[len(a) // 2 + 1]) // 2 as bigint) as median, a[-1] as max from usual")
def _w03(spark, sf):
    return ops.usual_amounts(A.transactions(spark, sf))


_GAPS = Q.O + ", g as (select *, date_diff('day', lag(date) over (partition by entry order by date, id), date) as gap from ord)"


@query("W04_A17_gaps", _GAPS + " select entry, round(avg(gap), 6) as mean, round(stddev_pop(gap), 6) as spread from g group by entry")
def _w04(spark, sf):
    return cluster.gaps(A.orders(spark, sf), "entry").groupBy("entry").agg(F.round(F.avg("gap"), 6).alias("mean"), F.round(F.stddev_pop("gap"), 6).alias("spread"))


@query("W05_M10_gap_chunks", _GAPS + ", c as (select *, sum(case when gap > 365 then 1 else 0 end) over (partition by entry order by date, id rows unbounded preceding) as chunk from g) select entry, cast(chunk as bigint) as chunk, min(date) as start_date, max(date) as end_date, count(*) as n from c group by entry, chunk")
def _w05(spark, sf):
    return cluster.gap_chunks(A.orders(spark, sf), "entry", F.lit(360))


_TREND = """, p as (select *, date_diff('day', date '1970-01-01', date) as x, 3 * period_days as w from rates),
tr as (select a.entry, a.date, count(*) as k, regr_slope(b.actual, b.x) as s, regr_r2(b.actual, b.x) as r from p a join p b on a.entry = b.entry and b.x between a.x - a.w and a.x group by a.entry, a.date)"""


@query("W07_M15_trend", Q.RATES + _TREND + " select entry, date, round(case when k >= 2 then coalesce(s, 0.0) else 0.0 end, 6) as slope, round(case when k >= 2 then coalesce(r, 0.0) else 0.0 end, 3) as r_squared from tr")
def _w07(spark, sf):
    return ops.trends(rates(spark, sf), "entry").select("entry", "date", "slope", "r_squared")


@query("W10_prior_rate", Q.RATES + " select entry, date, lag(actual) over (partition by entry order by date) as prior from rates")
def _w10(spark, sf):
    return ops.with_prior(rates(spark, sf)).select("entry", "date", "prior")


@query("W11_W12_viewport", Q.RATES + ", b as (select entry, date, actual, row_number() over (partition by entry order by date desc) as k from rates) select entry, date, actual from b where k between 3 and 16")
def _w11(spark, sf):
    recent = rates(spark, sf).select("entry", "date", "actual")
    return ops.viewport(recent.filter("date > date'2024-01-20'"), recent, 14, 2)


_LABELS = """, labels_ as (select entity, label, date, round(sum(actual), 4) as actual, round(sum(projected), 4) as projected, cast(sum(count) as bigint) as count, max(period_days) as period_days,
  case when bool_and(direction = 'mixed') then 'mixed' when bool_or(direction = 'income') then 'income' else 'spend' end as direction, count(*) as entries from rates group by entity, label, date)"""


@query("A16_M13_label_rates", Q.RATES + _LABELS + " select * from labels_")
def _a16(spark, sf):
    return ops.label_rates(rates(spark, sf))


@query("M11_U03_dirty", Q.RATES.rsplit(",\ndaily as", 1)[0] + """, stored as (select entry, date from grid where day(date) % 7 <> 0 and date < date '2024-01-20'),
    last_ as (select entry, max(date) as d from stored group by entry)
    select g.entry, g.date from grid g left join last_ l using (entry) left join stored s on s.entry = g.entry and s.date = g.date
    where g.date >= (select as_of from bounds) - 5 or g.date >= coalesce(l.d, g.start_date) or s.entry is null""")
def _m11(spark, sf):
    txns, entries = _both(spark, sf)
    days = ops.grid(entries.crossJoin(F.broadcast(ops.as_of(txns))), F.col("as_of"))
    stored = days.filter("day(date) % 7 <> 0 and date < date'2024-01-20'").select("entry", "date")
    return ops.dirty_days(entries, txns, stored, 5)


@query("M16_M17_U01_snapshots", Q.RATES + _TREND + _LABELS + """, lp as (select *, entity || ':' || label as node, date_diff('day', date '1970-01-01', date) as x, 3 * period_days as w from labels_),
    lt as (select a.node, a.date, count(*) as k, regr_slope(b.actual, b.x) as s, regr_r2(b.actual, b.x) as r from lp a join lp b on a.node = b.node and b.x between a.x - a.w and a.x group by a.node, a.date)
    select entry as node, 'entry' as node_type, date, actual, projected, drift, round(case when k >= 2 then coalesce(s, 0.0) else 0.0 end, 6) as slope, round(case when k >= 2 then coalesce(r, 0.0) else 0.0 end, 3) as r_squared, count as transactions, days as window_days, total
      from rates join tr using (entry, date)
    union all select node, 'label', date, actual, projected, round(actual - projected, 4), round(case when k >= 2 then coalesce(s, 0.0) else 0.0 end, 6), round(case when k >= 2 then coalesce(r, 0.0) else 0.0 end, 3), entries, period_days, cast(0 as bigint)
      from lp join lt using (node, date)""")
def _m16(spark, sf):
    return ops.snapshots(*_both(spark, sf), Q.WINDOW)


@query("K03_K04_upsert", Q.RATES + " select entry, date, case when date >= date '2024-01-20' then actual else 0.0 end as actual from rates where date >= date '2024-01-20' or date < date '2024-01-25'")
def _k03(spark, sf):
    r = rates(spark, sf).select(F.col("entry").alias("node"), "date", "actual")
    old = r.filter("date < date'2024-01-25'").withColumn("actual", F.lit(0.0))
    return ops.merge_snapshots(old, r.filter("date >= date'2024-01-20'")).withColumnRenamed("node", "entry")


_CANON = Q.O + r""", n as (select distinct merchant from ord), c as (select merchant, array_to_string(list_filter(string_split(merchant, ' '), lambda t: lower(t) <> 'com'), ' ') as canonical from n),
w as (select distinct_.canonical, unnest(string_split(lower(distinct_.canonical), ' ')) as word from (select distinct canonical from c) distinct_),
df as (select word, count(*) as df from w group by word having count(*) >= 2),
best as (select canonical, word from w join df using (word) qualify row_number() over (partition by canonical order by df desc, contains(word, '-'), length(word) desc, word) = 1),
k as (select c.merchant, c.canonical, coalesce(array_to_string(list_transform(string_split(word, '-'), lambda s: upper(s[1:1]) || lower(s[2:])), '-'), canonical) as cluster from c left join best using (canonical))"""


@query("M05_A20_L10_clusters", _CANON + " select distinct canonical, cluster from k")
def _m05(spark, sf):
    return cluster.cluster_keys(A.orders(spark, sf))


_SCORE = """, gaps_ as (select *, date_diff('day', lag(date) over (partition by entry order by date, id), date) as gap from ord),
st as (select entry, count(*) as n, avg(gap) as mean_gap, stddev_pop(gap) as spread, list_sort(list(cents)) as a from gaps_ group by entry),
md as (select *, (a[(len(a) + 1) // 2] + a[len(a) // 2 + 1]) // 2 as median from st),
ft as (select *, case when n < 2 then 0.0 when spread <= 5 then 1.0 else 5.0::double / spread end as timing_fit,
  case when n = 1 or median = 0 then 1.0 else greatest(0.0, 1.0 - least(greatest(abs(a[1] - median), abs(a[-1] - median)) / abs(median), 1.0)) end as amount_fit from md)"""


@query("M06_A18_score", Q.O + _SCORE + """ select entry, n, cast(median as bigint) as median, round(timing_fit, 6) as timing_fit, round(amount_fit, 6) as amount_fit, case when n >= 2 and timing_fit >= 0.45 then 'standing' else 'variable' end as entry_type,
    round(case when n >= 2 and timing_fit >= 0.45 then 0.3::double + 0.55::double * timing_fit + 0.15::double * amount_fit else 0.6::double + 0.2::double * timing_fit + 0.2::double * amount_fit end, 6) as fitness from ft""")
def _m06(spark, sf):
    r = cluster.score(A.orders(spark, sf), "entry")
    return r.select("entry", "n", "median", F.round("timing_fit", 6).alias("timing_fit"), F.round("amount_fit", 6).alias("amount_fit"), "entry_type", F.round("fitness", 6).alias("fitness"))


@query("M07_A19_anchors", Q.O + """, o2 as (select *, case when entry % 3 = 0 then cast(date '2025-01-01' + to_months(cast(row_number() over (partition by entry order by date, id) as integer)) as date) when entry % 3 = 1 then date '2025-01-06' + cast(7 * row_number() over (partition by entry order by date, id) as integer) else date end as d2 from ord),
    g as (select entry, d2, date_diff('day', lag(d2) over (partition by entry order by d2, id), d2) as gap, case when day(d2) > 28 then day(d2) - day(last_day(d2)) - 1 else day(d2) end as dom from o2),
    m as (select entry, dom as mode from (select entry, dom, count(*) as k from g group by all) qualify row_number() over (partition by entry order by k desc, dom) = 1),
    f as (select entry, avg(gap) as mean, count(*) as n, count(distinct isodow(d2)) as nd, min(isodow(d2) - 1) as dow, list_sort(list(distinct dom)) as doms from g group by entry)
    select entry, case when n < 2 or mean is null then null when mean between 5 and 9 and nd = 1 then 'dow:' || dow when mean between 13 and 17 and len(doms) = 2 then 'dom:' || array_to_string(list_concat(list_filter(doms, lambda d: d > 0), list_filter(doms, lambda d: d < 0)), ',')
      when mean between 20 and 45 and len(list_filter(doms, lambda d: abs(d - mode) > 5)) = 0 then 'dom:' || mode else 'interval:' || cast(round(mean) as integer) end as anchor from f join m using (entry)""")
def _m07(spark, sf):
    k = F.row_number().over(Window.partitionBy("entry").orderBy("date", "id"))
    o = A.orders(spark, sf).withColumn("k", k)
    date = F.when(F.col("entry") % 3 == 0, F.add_months(F.lit("2025-01-01").cast("date"), F.col("k"))).when(F.col("entry") % 3 == 1, F.date_add(F.lit("2025-01-06").cast("date"), 7 * F.col("k"))).otherwise(F.col("date"))
    return cluster.anchors(o.withColumn("date", date), "entry")


_PROPOSALS = _CANON + """, o3 as (select ord.*, cluster, case when day(date) > 28 then day(date) - day(last_day(date)) - 1 else day(date) end as dom from ord join k using (merchant)),
    g as (select *, date_diff('day', lag(date) over (partition by cluster order by date, id), date) as gap from o3),
    st as (select cluster, count(*) as n, avg(gap) as mean_gap, stddev_pop(gap) as spread, list_sort(list(cents)) as a, count(distinct isodow(date)) as nd, min(isodow(date) - 1) as dow, list_sort(list(distinct dom)) as doms,
      bool_and(starts_with(lower(merchant), lower(cluster))) as all_start, min(date) as start_date, max(date) as last_date, list_sort(list(distinct merchant))[1:5] as sample_merchants from g group by cluster),
    mo as (select cluster, dom as mode from (select cluster, dom, count(*) as c from g group by all) qualify row_number() over (partition by cluster order by c desc, dom) = 1),
    md as (select *, (a[(len(a) + 1) // 2] + a[len(a) // 2 + 1]) // 2 as median from st join mo using (cluster)),
    ft as (select *, case when n < 2 then 0.0 when spread <= 5 then 1.0 else 5.0::double / spread end as timing_fit,
      case when n = 1 or median = 0 then 1.0 else greatest(0.0, 1.0 - least(greatest(abs(a[1] - median), abs(a[-1] - median)) / abs(median), 1.0)) end as amount_fit,
      case when n < 2 or mean_gap is null then null when mean_gap between 5 and 9 and nd = 1 then 'dow:' || dow when mean_gap between 13 and 17 and len(doms) = 2 then 'dom:' || array_to_string(list_concat(list_filter(doms, lambda d: d > 0), list_filter(doms, lambda d: d < 0)), ',')
        when mean_gap between 20 and 45 and len(list_filter(doms, lambda d: abs(d - mode) > 5)) = 0 then 'dom:' || mode else 'interval:' || cast(round(mean_gap) as integer) end as anchor from md),
    fi as (select *, case when n >= 2 and timing_fit >= 0.45 then 'standing' else 'variable' end as entry_type, coalesce(greatest(cast(round(mean_gap) as integer), 1), 30) as period_days,
      case when n >= 2 and timing_fit >= 0.45 then 0.3::double + 0.55::double * timing_fit + 0.15::double * amount_fit else 0.6::double + 0.2::double * timing_fit + 0.2::double * amount_fit end as fitness from ft)
    select cluster, case when median < 0 then 'spend' else 'income' end as direction, entry_type, period_days, round(median / period_days, 4) as projected_rate_per_day,
      '{"op":"AND","children":[{"type":"' || case when all_start then 'payee_starts_with' else 'payee_contains' end || '","value":"' || cluster || '"}'
        || case when entry_type = 'standing' and anchor is not null then ',{"type":"recurrence_anchor","recurrence_anchor":"' || anchor || '","tolerance_days":5}' else '' end
        || case when entry_type = 'standing' then ',{"type":"amount_range","min_cents":' || a[1] || ',"max_cents":' || a[-1] || '}' else '' end || ']}' as conditions,
      anchor, round(fitness, 6) as fitness, round(timing_fit, 6) as timing_fit, round(amount_fit, 6) as amount_fit, n, start_date, last_date, sample_merchants from fi where fitness >= 0.3"""


@query("M08_M09_proposals", _PROPOSALS)
def _m08(spark, sf):
    rows = cluster.propose(A.orders(spark, sf))
    places = {"projected_rate_per_day": 4, "fitness": 6, "timing_fit": 6, "amount_fit": 6}
    return rows.withColumns({c: F.round(c, k) for c, k in places.items()})


_DUE = """case when anchor = 'dow:0' then cast(last_date + 1 + cast((0 - (isodow(last_date + 1) - 1) + 7) % 7 as integer) as date)
  when anchor = 'dom:15' then case when day(last_date) < 15 then cast(date_trunc('month', last_date) + interval 14 days as date) else cast(date_trunc('month', last_date) + interval 1 month + interval 14 days as date) end
  when anchor = 'dom:-1' then case when last_date < last_day(last_date) then last_day(last_date) else last_day(cast(last_date + interval 1 month as date)) end
  when anchor = 'interval:14' then last_date + 14 else last_date + period_days end"""
_PROJECT = Q.RATES + f""", s as (select * from rates qualify row_number() over (partition by entry order by date desc) = 1),
src as (select e.*, cast({_DUE.replace("period_days", "e.period_days")} as date) as due, b.as_of, cast(floor(abs(s.actual)) as bigint) as rate from entries e join s using (entry), bounds b where e.status = 'live'),
ahead as (select src.*, cast(as_of + cast(k as integer) as date) as date from src, range(0, 91) r(k)),
cov as (select *, case when due is null then false when anchor is null then date >= due and date < due + period_days when anchor = 'dow:0' then isodow(date) = 1
  when anchor = 'dom:15' then date_diff('day', case when day(date) >= 15 then cast(date_trunc('month', date) + interval 14 days as date) else cast(date_trunc('month', date) - interval 1 month + interval 14 days as date) end, date) <= 45
  when anchor = 'dom:-1' then true else date >= due end as on_ from ahead),
days as (select entity, date, cast(sum(case when on_ and direction = 'income' then rate else 0 end) as bigint) as income, cast(sum(case when on_ and direction = 'spend' then rate else 0 end) as bigint) as spend from cov group by entity, date)"""


def _projected(spark, sf):
    txns, entries = _both(spark, sf)
    latest = summary.latest_per_entry(rates(spark, sf)).select("entry", "actual", "projected")
    due = D.next_due_date(F.col("anchor"), F.col("period_days"), F.col("last_date"))
    live = entries.filter("status = 'live'").join(latest, "entry").withColumn("due", due).withColumn("rate", projection.projected_rate(F.col("actual"), F.col("projected")))
    return live.crossJoin(F.broadcast(ops.as_of(txns))).withColumn("balance", F.lit(100000))


@query("M18_W09_coverage", _PROJECT + " select entry, date, on_ as covered from cov")
def _m18(spark, sf):
    ahead = _projected(spark, sf).withColumn("date", F.explode(F.sequence(F.col("as_of"), F.date_add("as_of", projection.HORIZON))))
    return ahead.select("entry", "date", projection.covers(F.col("date"), F.col("due"), F.col("anchor"), F.col("period_days")).alias("covered"))


@query("M19_W08_projection", _PROJECT + " select entity, date, income, spend, income - spend as margin, cast(100000 + sum(income - spend) over (partition by entity order by date) as bigint) as balance, income - spend < 0 as pinch from days")
def _m19(spark, sf):
    return projection.project(_projected(spark, sf), ["entity"])


@query("M20_ended", Q.TE + f", d as (select *, cast({_DUE} as date) as due from entries where status in ('live', 'pending') and end_date is null) select entry, due as ends, 'pending' as status, 'ended' as alert_type from d where date '2024-02-14' > due + 5")
def _m20(spark, sf):
    _, entries = _both(spark, sf)
    due = D.next_due_date(F.col("anchor"), F.col("period_days"), F.col("last_date"))
    return projection.ended(entries.withColumn("due", due).withColumn("as_of", F.lit("2024-02-14").cast("date"))).select("entry", "ends", "status", "alert_type")


@query("M21_system_sync", Q.RATES + " select e.entry, case when e.label = 'signup' then s.projected else -1.0 end as rate from entries e left join (select * from rates qualify row_number() over (partition by entry order by date desc) = 1) s using (entry)")
def _m21(spark, sf):
    _, entries = _both(spark, sf)
    entries = entries.withColumns({"source": F.when(F.col("label") == "signup", "system").otherwise("user"), "rate": F.lit(-1.0)})
    return ops.synced_rates(entries, summary.latest_per_entry(rates(spark, sf)), "rate").select("entry", "rate")


@query("M22_settlement_window", Q.T + ", accounts as (select c_custkey, c_nationkey as institution from customer where c_acctbal > 0), m as (select n_nationkey as institution, n_nationkey % 9 + 3 as d from nation where n_regionkey = 1) select cast(coalesce(max(d), 7) as integer) as days from accounts join m using (institution)")
def _m22(spark, sf):
    accounts = A.table(spark, sf, "customer").select(F.col("c_nationkey").alias("institution"), F.when(F.col("c_acctbal") > 0, "active").otherwise("passive").alias("status"))
    mappings = A.table(spark, sf, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("institution"), (F.col("n_nationkey") % 9 + 3).alias("settlement_window_days"))
    return lifecycle.settlement_window(accounts, mappings)


@query("K09_delete_with_balance", Q.A + " select a.account, cast(starting - coalesce((select sum(cents) from txn t where t.account = a.account and id % 7 = 0), 0) as bigint) as balance from accounts a")
def _k09(spark, sf):
    txns = A.transactions(spark, sf)
    accounts = A.accounts(spark, sf).withColumn("balance", F.col("starting"))
    return lifecycle.delete_with_balance(txns, txns.filter("id % 7 = 0").select("id"), accounts)[1].select("account", "balance")


@query("K11_review", Q.TE + """ select entry as id, case when entity = 4 and label <> 'click' then 'ended' when entity = 4 then 'live' else status end as status, case when entity = 4 and label <> 'click' then date '2024-01-25' else end_date end as end_date from entries""")
def _k11(spark, sf):
    _, entries = _both(spark, sf)
    rows = entries.withColumnRenamed("entry", "id").withColumn("alert_type", F.when(F.col("label") != "click", "ended").otherwise("new"))
    return lifecycle.review(rows, F.col("entity") == 4, True, F.lit("2024-02-01").cast("date")).select("id", "status", "end_date")


@query("K12_orphan_labels", "select n_name as id, case when n_nationkey = 0 then 'system' else 'user' end as source from nation where n_nationkey = 0 or exists (select 1 from supplier where s_nationkey = n_nationkey and s_acctbal < 0)")
def _k12(spark, sf):
    n = A.table(spark, sf, "nation")
    labels = n.select(F.col("n_name").alias("id"), F.when(F.col("n_nationkey") == 0, "system").otherwise("user").alias("source"))
    used = A.table(spark, sf, "supplier").filter("s_acctbal < 0").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("label_id"))
    return lifecycle.drop_orphan_labels(labels, used)


@query("K02_replace_assignments", Q.T + " select entity, id as transaction, entry, 0.5 as fit from txn where entity <> 2 union all select 2, id, entry, 0.9 from txn where entity = 2 and id % 2 = 0")
def _k02(spark, sf):
    t = A.transactions(spark, sf).select("entity", F.col("id").alias("transaction"), "entry")
    new = t.filter("entity = 2 and transaction % 2 = 0")
    new = new.withColumn("fit", F.lit(0.9)).unionByName(new.withColumn("fit", F.lit(0.2)))
    return lifecycle.replace_assignments(t.withColumn("fit", F.lit(0.5)), new, F.col("entity") == 2)


@query("K08_K15_jobs_exports", "select event_id as id, case when event_id = 5 then 'complete' else 'queued' end as status, ts < timestamp '2024-01-20' as kept from events where ts >= timestamp '2024-01-10'")
def _k08(spark, sf):
    e = A.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.lit("queued").alias("status"), F.col("ts").alias("expires_at"), F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("completed_at"), F.lit(None).cast("string").alias("error"))
    jobs = lifecycle.job_transition(e, 5, "complete", F.lit("2024-02-01").cast("timestamp"))
    kept = lifecycle.purge_exports(jobs, F.lit("2024-01-10").cast("timestamp"))
    return kept.select("id", "status", (F.col("expires_at") < F.lit("2024-01-20").cast("timestamp")).alias("kept"))
