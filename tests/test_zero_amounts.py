"""Transactions of no amount: their direction is that of the entries that hold them, in the plans and in their SQL."""

import duckdb
import pytest

from ratewright import plans, registry  # noqa: F401


@pytest.mark.parametrize("name", ["M04_second_pass", "P16_P23_entry_leaves"])
def test_rows_of_no_amount_match_the_sql(spark, tmp_path, name):
    con = duckdb.connect()
    kinds = "['click', 'signup', 'purchase', 'view'][i % 4 + 1]"
    con.execute(f"create table events as select i as event_id, timestamp '2024-01-01' + interval (i % 29) day as ts, i % 50 as user_id, {kinds} as event_type, case when i % 3 = 0 then 35.5 else 0.0 end as value, '' as props from range(240) r(i)")
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    q = registry.QUERIES[name]
    frame = q.build(spark, str(tmp_path))
    got = sorted(map(repr, map(tuple, frame.collect())))
    assert got and got == sorted(map(repr, con.execute(f"select {', '.join(frame.columns)} from ({q.sql})").fetchall()))
