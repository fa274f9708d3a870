"""Queries on column functions: text, money, dates, rates (F01-F37), and statement parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratewright.functions import dates as D
from ratewright.functions import money as M
from ratewright.functions import rates as R
from ratewright.functions import text as T
from ratewright.registry import query
from ratewright.sources import adapters as A
from ratewright.sources import statements as S

from . import sql as Q

_PAYEE = "upper(p_name) || '.COM*MK' || p_partkey || '  /' || p_brand || ' # walk-in'"
_WORDS_SQL = "array_to_string(list_transform(string_split({}, ' '), lambda w: array_to_string(list_transform(string_split(w, '-'), lambda s: upper(s[1:1]) || lower(s[2:])), '-')), ' ')"
_NORMAL_SQL = _WORDS_SQL.format(r"regexp_replace(trim(regexp_replace(regexp_replace({}, '[.*/]', ' ', 'g'), '\s+', ' ', 'g')), '[^\p{{L}}\p{{N}}\s&-]', '', 'g')").format(_PAYEE)


def _parts(spark, sf):
    return A.table(spark, sf, "part").withColumn("payee", F.expr("concat(upper(p_name), '.COM*MK', p_partkey, '  /', p_brand, ' # walk-in')"))


@query("F01_normalize_merchant", f"select p_partkey, {_NORMAL_SQL} as merchant from part")
def _f01(spark, sf):
    return _parts(spark, sf).select("p_partkey", T.normalize_merchant(F.col("payee")).alias("merchant"))


_LCS_SQL = f"""with recursive t as (select p_partkey, lower(p_name) as a, lower({_NORMAL_SQL}) as b from part),
    r as (select p_partkey, 0 as i, list_transform(range(length(b) + 1), lambda x: 0) as row from t
      union all select p_partkey, i + 1, list_transform(range(1, length(b) + 2), lambda j: list_max(best[1:j])) from (
        select p_partkey, i, b, list_concat([0], list_transform(range(1, length(b) + 1), lambda j: case when b[j:j] = a[i + 1:i + 1] then row[j] + 1 else row[j + 1] end)) as best from r join t using (p_partkey) where i < length(a)) s)
    select p_partkey, row[-1]::integer as lcs, case when greatest(length(a), length(b)) = 0 then 0.0 else round(row[-1] / greatest(length(a), length(b)), 6) end as ratio from r join t using (p_partkey) where i = length(a)"""


@query("F02_F03_lcs", _LCS_SQL)
def _f02(spark, sf):
    p = _parts(spark, sf).select("p_partkey", F.lower("p_name").alias("a"), F.lower(T.normalize_merchant(F.col("payee"))).alias("b"))
    return p.select("p_partkey", T.lcs_length(F.col("a"), F.col("b")).alias("lcs"), F.round(T.lcs_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@query(
    "F04_F05_parse_amount",
    r"""with t as (select p_partkey, [cast(p_retailprice as varchar), '-1,2' || p_size || '.5', ' ' || p_size || ' ', '.50', '-' || p_size || '.999', 'x' || p_size, p_size || '.'][p_partkey % 7 + 1] as s from part),
    u as (select *, regexp_replace(s, '[\s,]', '', 'g') as x from t),
    v as (select *, regexp_extract(x, '^-?([0-9]+)(?:\.([0-9]*))?$', 1) as w, regexp_extract(x, '^-?([0-9]+)(?:\.([0-9]*))?$', 2) as f from u),
    c as (select *, case when w <> '' then cast(w || rpad(f[1:2], 2, '0') as bigint) * case when starts_with(x, '-') then -1 else 1 end end as cents from v)
    select p_partkey, cents is not null as ok, coalesce(cents, 0) as cents, coalesce(-cents, 0) as flipped from c""",
)
def _f04(spark, sf):
    forms = "array(cast(p_retailprice as string), concat('-1,2', p_size, '.5'), concat(' ', p_size, ' '), '.50', concat('-', p_size, '.999'), concat('x', p_size), concat(p_size, '.'))"
    cents = M.parse_cents(F.expr(f"get({forms}, cast(p_partkey % 7 as int))"))
    flipped = F.coalesce(M.with_sign(cents, "positive_is_debit"), F.lit(0))
    return A.table(spark, sf, "part").select("p_partkey", cents.isNotNull().alias("ok"), F.coalesce(cents, F.lit(0)).alias("cents"), flipped.alias("flipped"))


@query("F06_parse_date", "select o_orderkey, case when o_orderkey % 6 < 5 then cast(o_orderdate as date) end as date from orders")
def _f06(spark, sf):
    day = "o_orderdate"
    forms = [F.date_format(day, f) for f in ("yyyy-MM-dd", "MM/dd/yyyy", "M/d/yyyy", "dd-MMM-yyyy", "MMMM d, yyyy")]
    text = F.get(F.array(*forms, F.lit("no date")), (F.col("o_orderkey") % 6).cast("int"))
    return A.table(spark, sf, "orders").select("o_orderkey", D.parse_date(text).alias("date"))


_NOISE_SQL = ", ".join(f"'{w}'" for w in T.NOISE)


@query(
    "F07_canonical",
    Q.O + rf""", m as (select distinct merchant from ord),
    t as (select merchant, list_filter(string_split_regex(trim(merchant), '\s+'), lambda t: lower(t) not in ({_NOISE_SQL}) and not regexp_full_match(t, '[0-9]+')) as w from m)
    select merchant, case when len(w) > 0 then array_to_string(w, ' ') else merchant end as canonical from t""",
)
def _f07(spark, sf):
    return A.orders(spark, sf).select("merchant").distinct().select("merchant", T.canonical_merchant(F.col("merchant")).alias("canonical"))


@query(
    "F08_F09_settlement",
    Q.T + """, a as (select max(date) as anchor from txn)
    select id, case when date < anchor - 14 then 'settled' else 'flux' end as stored,
      case when date < anchor - 14 then 'settled' when date < anchor - 7 then 'aged_flux' else 'young_flux' end as effective from txn, a""",
)
def _f08(spark, sf):
    t = A.transactions(spark, sf)
    rows = t.crossJoin(F.broadcast(t.agg(F.max("date").alias("anchor"))))
    stored = D.settlement_status(F.col("date"), F.col("anchor"), F.lit(14))
    return rows.select("id", stored.alias("stored"), D.effective_status(stored, F.col("date"), F.col("anchor"), F.lit(7)).alias("effective"))


@query(
    "F10_F15_calendar",
    """with d as (select distinct cast(o_orderdate as date) as date from orders),
    n as (select date, day(date) as dom, day(last_day(date)) as dim, cast(isodow(date) - 1 as bigint) as wd from d),
    months as (select date, unnest(range(0, 25)) as k from d),
    fires as (select date, min(case when day(last_day(m)) >= 31 then m + 30 end) as next31, min(case when cast(last_day(m) as date) > date then cast(last_day(m) as date) end) as next_last
      from (select date, cast(date_trunc('month', date) + to_months(cast(k as integer)) as date) as m from months) group by date)
    select date, dom, dim, wd, case when dom > 28 then dom - dim - 1 else dom end as normal, case when 30 <= dim then 30 else 0 end as dom30, dim - 1 as second_last,
      cast(date + 1 + cast((2 - (isodow(date + 1) - 1) + 7) % 7 as integer) as date) as next_wednesday,
      (select min(x) from (select cast(date_trunc('month', n.date) + to_months(cast(k as integer)) as date) + 30 as x, cast(date_trunc('month', n.date) + to_months(cast(k as integer)) as date) as m from range(0, 25) r(k))
        where x > n.date and day(last_day(m)) = 31) as next_31st, next_last as next_last_day
    from n join fires using (date)""",
)
def _f10(spark, sf):
    day, lit = F.col("date"), F.lit
    days = A.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return days.select(
        "date",
        F.dayofmonth(day).cast("bigint").alias("dom"),
        D.days_in_month(day).cast("bigint").alias("dim"),
        F.weekday(day).cast("bigint").alias("wd"),
        D.normalize_dom(day).cast("bigint").alias("normal"),
        F.coalesce(D.resolve_dom(lit(30), day), lit(0)).alias("dom30"),
        D.resolve_dom(lit(-2), day).cast("bigint").alias("second_last"),
        D.next_dow_after(lit(2), day).alias("next_wednesday"),
        D.next_dom_after(F.array(lit(31)), day).alias("next_31st"),
        D.next_dom_after(F.array(lit(-1)), day).alias("next_last_day"),
    )


_DUE_SQL = """case when anchor like 'dow:%' then cast(last_date + 1 + cast((cast(split_part(anchor, ':', 2) as integer) - (isodow(last_date + 1) - 1) + 7) % 7 as integer) as date)
  when anchor = 'dom:15' then case when day(last_date) < 15 then cast(date_trunc('month', last_date) + interval 14 days as date) else cast(date_trunc('month', last_date) + interval 1 month + interval 14 days as date) end
  when anchor = 'dom:-1' then case when last_date < last_day(last_date) then last_day(last_date) else last_day(cast(last_date + interval 1 month as date)) end
  when anchor like 'interval:%' then last_date + cast(split_part(anchor, ':', 2) as integer) else last_date + period_days end"""


@query("F16_F17_next_due", Q.TE + f" select entry, anchor, split_part(anchor, ':', 1) as kind, cast({_DUE_SQL} as date) as due from entries")
def _f16(spark, sf):
    e = A.entries(A.transactions(spark, sf))
    return e.select("entry", "anchor", D.anchor_kind(F.col("anchor")).alias("kind"), D.next_due_date(F.col("anchor"), F.col("period_days"), F.col("last_date")).alias("due"))


@query(
    "F18_cadence",
    """select * from (values ('dom:-1', 'monthly:last'), ('dom:15', 'monthly:15'), ('dom:1,15', 'semimonthly:1,15'), ('dow:4', 'weekly:friday'), ('interval:14', 'every:14')) t(anchor, cadence)""",
)
def _f18(spark, sf):
    found = [(D.anchor_of_cadence(c), c) for c in ("monthly:last", "monthly:15", "semimonthly:1,15", "weekly:friday", "every:14")]
    return spark.createDataFrame([(a, D.cadence_of_anchor(a)) for a, _ in found], "anchor string, cadence string")


@query(
    "F19_dom_fires",
    """with c as (select c_custkey, c_custkey % 31 + 1 as v, date '2025-01-10' as a, date '2025-12-20' as b from customer),
    m as (select c_custkey, v, a, b, cast(date '2025-01-01' + to_months(cast(k as integer)) as date) as m from c, range(0, 12) r(k)),
    f as (select c_custkey, m + cast(v - 1 as integer) as fire, a, b from m where v <= day(last_day(m)) union select c_custkey, last_day(m), a, b from m)
    select distinct c_custkey, cast(fire as date) as fire from f where fire between a and b""",
)
def _f19(spark, sf):
    c = A.table(spark, sf, "customer").select("c_custkey", F.expr("array(cast(c_custkey % 31 + 1 as int), -1)").alias("values"), F.lit("2025-01-10").cast("date").alias("a"), F.lit("2025-12-20").cast("date").alias("b"))
    return D.dom_fires(c, "values", "a", "b").select("c_custkey", "fire")


@query("F20_lapsed", Q.TE + f", d as (select *, cast({_DUE_SQL} as date) as due from entries) select entry, case when date '2024-02-10' > due + 5 then due end as ends from d")
def _f20(spark, sf):
    e = A.entries(A.transactions(spark, sf))
    due = D.next_due_date(F.col("anchor"), F.col("period_days"), F.col("last_date"))
    return e.select("entry", D.lapsed_on(due, F.col("last_date"), F.col("period_days"), F.lit("2024-02-10").cast("date")).alias("ends"))


@query("F21_tolerance", Q.O + " select id, abs(cents - (cents + id % 1000)) <= floor(abs(cents) * 0.00001) as close from ord")
def _f21(spark, sf):
    return A.orders(spark, sf).select("id", M.within_tolerance(F.col("cents"), F.col("cents") + F.col("id") % 1000, 0.00001).alias("close"))


@query(
    "F22_F27_rates",
    Q.TE + """, s as (select e.entry, direction, sum(cents) as total, date_diff('day', min(date), max(date)) as span from entries e join txn using (entry) group by all),
    r as (select entry, direction, cast(total as bigint) as total, case when span = 0 then 0.0 else total / span end as rate, least(greatest(span, 1), 7) as days from s)
    select entry, total, days, round(rate, 6) as rate, case when direction = 'spend' then -1 else 1 end as sign, round(rate - total, 4) as drift, round(rate / 100 * 30.44, 6) as monthly, round(rate / 100 * 365.0, 6) as yearly,
      cast(least(greatest(case when abs(total) + 500000 > 0 then floor(abs(total) / (abs(total) + 500000) * 100) else 0 end, 0), 100) as bigint) as percent from r""",
)
def _f22(spark, sf):
    t = A.transactions(spark, sf)
    s = A.entries(t).join(t.select("entry", "cents", "date"), "entry").groupBy("entry", "direction").agg(F.sum("cents").alias("total"), F.min("date").alias("a"), F.max("date").alias("b"))
    rate = R.actual_rate(F.col("total"), F.date_diff("b", "a"))
    days = R.window_days(F.col("b"), F.col("a"), 7).cast("bigint")
    spend = R.spend_percent(F.col("total"), F.abs("total") + 500000)
    return s.select(
        "entry", "total", days.alias("days"), F.round(rate, 6).alias("rate"), R.sign_of(F.col("direction")).alias("sign"), F.round(R.drift(rate, F.col("total")), 4).alias("drift"),
        F.round(R.in_dollars(rate, "month"), 6).alias("monthly"), F.round(R.in_dollars(rate, "year"), 6).alias("yearly"), spend.alias("percent"),
    )


@query("F28_currency", Q.O + " select id, case when cents < 0 then '-' else '' end || '$' || format('{:,}', abs(cents) // 100) || '.' || lpad(cast(abs(cents) % 100 as varchar), 2, '0') as amount from ord")
def _f28(spark, sf):
    return A.orders(spark, sf).select("id", R.currency(F.col("cents")).alias("amount"))


@query(
    "F29_F36_misc",
    r"""select event_id, cast(json_extract(props, '$.k') as bigint) as k, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as stamp, least(value, 100.0) as capped, coalesce(nullif(event_type, 'view'), 'none') as kind,
      cast(ts as date) + 3 as later, to_base64(encode(cast(cast(ts as date) as varchar) || ',' || event_id)) as cursor, cast(value as varchar) is not null as known,
      '{"id":' || event_id || ',"type":"' || event_type || '"}' as payload from events""",
)
def _f29(spark, sf):
    e = A.table(spark, sf, "events")
    day = F.to_date("ts")
    return e.select(
        "event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"), F.least("value", F.lit(100.0)).alias("capped"),
        F.coalesce(F.nullif("event_type", F.lit("view")), F.lit("none")).alias("kind"), F.date_add(day, 3).alias("later"),
        F.base64(F.concat_ws(",", day.cast("string"), F.col("event_id").cast("string")).cast("binary")).alias("cursor"),
        F.col("value").cast("string").isNotNull().alias("known"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("payload"),
    )


_STATEMENT = """with s as (select o_orderkey as id, strftime(o_orderdate, '%m/%d/%Y') as day, cast(o_orderdate as date) as date, cast(round(o_totalprice * 100) as bigint) as c,
  ['DEBIT', ' dr ', 'CREDIT', 'other'][o_orderkey % 4 + 1] as ind from orders)"""


def _statement(spark, sf):
    o = A.table(spark, sf, "orders")
    amount = F.expr("cast(cast(round(o_totalprice * 100) as bigint) / 100 as decimal(18,2))").cast("string")
    kind = F.expr("get(array('DEBIT', ' dr ', 'CREDIT', 'other'), cast(o_orderkey % 4 as int))")
    split = F.expr("o_orderkey % 3")
    return o.select(
        F.col("o_orderkey").cast("string").alias("Ref"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("Date"), F.col("o_orderpriority").alias("Description"), amount.alias("Amount"), kind.alias("Type"),
        F.when(split == 0, amount).when(split == 1, "0.00").otherwise("").alias("Debit"), F.when(split == 1, amount).otherwise(" ").alias("Credit"),
    )


def _parsed(spark, sf, layout, **fields):
    base = {"date": "Date", "merchant": "Description", "imported_id": "Ref"}
    rows = S.parse(_statement(spark, sf), S.Mapping.load({"layout": layout, "fields": base | fields}))
    return rows.select(F.col("imported_id").cast("bigint").alias("id"), "date", "cents")


@query("S02_csv_signed", _STATEMENT + " select id, date, -c as cents from s")
def _s02(spark, sf):
    return _parsed(spark, sf, "signed", amount="Amount", sign_convention="positive_is_debit")


@query("S03_csv_indicator", _STATEMENT + " select id, date, case when upper(trim(ind)) in ('DEBIT', 'DR', 'D', 'WITHDRAWAL') then -c else c end as cents from s")
def _s03(spark, sf):
    return _parsed(spark, sf, "indicator", amount="Amount", dc_indicator="Type")


@query("S04_csv_split", _STATEMENT + " select id, date, case id % 3 when 0 then -c else c end as cents from s where id % 3 < 2")
def _s04(spark, sf):
    return _parsed(spark, sf, "split", debit="Debit", credit="Credit")


@query("S08_prescan", 'select min(cast(o_orderdate as date)) as "first", max(cast(o_orderdate as date)) as "last", count(*) as rows from orders')
def _s08(spark, sf):
    return S.prescan(_statement(spark, sf).unionByName(_statement(spark, sf).limit(1).withColumn("Date", F.lit("n/a"))), "Date")


@query("S09_S11_scans", Q.T + " select id, date, cents from txn where entity = 3 and merchant in ('click', 'view') union all select id, date, cents from txn where id = 17")
def _s09(spark, sf):
    t = A.transactions(spark, sf)
    return t.filter("entity = 3 and merchant in ('click', 'view')").select("id", "date", "cents").unionByName(t.filter("id = 17").select("id", "date", "cents"))


@query("F39_names", "select c_custkey as id, case c_custkey % 3 when 0 then c_name when 1 then 'm' || c_custkey || '@x.org' else 'Ada Lovelace' end as name, case c_custkey % 3 when 0 then upper(c_name[1:2]) when 1 then 'M' || cast(c_custkey as varchar)[1:1] else 'AL' end as initials from customer")
def _f39(spark, sf):
    c = A.table(spark, sf, "customer")
    name = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).when(F.col("c_custkey") % 3 == 1, F.lit(" ")).otherwise("Ada  Lovelace ")
    email = F.concat(F.lit("m"), "c_custkey", F.lit("@x.org"))
    shown = F.regexp_replace(T.display_name(name, email), "  ", " ")
    return c.select(F.col("c_custkey").alias("id"), shown.alias("name"), T.initials(name, email).alias("initials"))

