"""Common table expressions that several queries' SQL begins with."""

from __future__ import annotations

from ratewright.sources.adapters import ACCOUNTS_SQL, ENTRIES_SQL, ORDERS_SQL, TXN_SQL

#: Days of the rolling window in the registered queries.
WINDOW = 7

T = f"with {TXN_SQL}"
TE = f"with {TXN_SQL}, {ENTRIES_SQL}"
O = f"with {ORDERS_SQL}"  # noqa: E741
A = f"with {TXN_SQL}, {ACCOUNTS_SQL}"

RATES = f"""{TE},
bounds as (select max(date) as as_of from txn),
grid as (select e.*, cast(unnest(generate_series(start_date, least(coalesce(end_date, as_of), as_of), interval 1 day)) as date) as date from entries e, bounds),
daily as (select entry, date, sum(cents) as cents, count(*) as n, list(abs(cents)) as amounts from txn group by entry, date),
usual as (select entry, date, list_sort(flatten(list(amounts) over (partition by entry order by date rows between unbounded preceding and current row))) as a from daily),
filled as (select g.*, d.cents, d.n, case rate_method when 'max' then a[-1] else (a[(len(a) + 1) // 2] + a[len(a) // 2 + 1]) // 2 end as usual
  from grid g left join daily d using (entry, date) left join usual u using (entry, date)),
rolled as (select *, coalesce(sum(cents) over w, 0) as total_, coalesce(sum(n) over w, 0) as count_, min(case when n > 0 then date end) over upto as earliest,
    last_value(usual ignore nulls) over upto as usual_
  from filled window w as (partition by entry order by date range between interval {WINDOW} days preceding and current row),
    upto as (partition by entry order by date rows between unbounded preceding and current row)),
measured as (select *, case when earliest is null then {WINDOW} else least(greatest(date_diff('day', earliest, date), 1), {WINDOW}) end as days_ from rolled),
rates as (select entry, entity, label, direction, period_days, status, date, cast(count_ as bigint) as count, cast(days_ as integer) as days, cast(total_ as bigint) as total,
    round(total_ / days_, 4) as actual, round(coalesce(usual_ / {WINDOW} * case when direction = 'spend' then -1 else 1 end, 0.0), 4) as projected,
    round(round(total_ / days_, 4) - round(coalesce(usual_ / {WINDOW} * case when direction = 'spend' then -1 else 1 end, 0.0), 4), 4) as drift from measured)"""
