"""The domain's tables as projections of a star schema with an event stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(amount: str) -> Column:
    return F.round(F.col(amount) * 100).cast("bigint")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense transactions: ``id, entity, account, date, merchant, entry, cents`` of every event."""
    sign = F.when(F.col("event_type") == "signup", 1).otherwise(-1)
    entity = F.col("user_id") % 5
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        entity.alias("entity"),
        F.col("user_id").alias("account"),
        F.to_date("ts").alias("date"),
        F.col("event_type").alias("merchant"),
        F.concat_ws(":", entity.cast("string"), "event_type").alias("entry"),
        (cents("value") * sign).alias("cents"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse transactions: ``id, entry, date, label, merchant, cents`` of every order; a customer is an entry."""
    sign = F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1)
    stems = F.array(*map(F.lit, ["Harbour Books", "Harbour Cafe", "Lumen Power", "Tallow & Wick", "Corner Grocer", "Ridge View", "Mill Water"]))
    ends = F.array(F.lit(""), F.lit(" Com"), F.concat(F.lit(" K-"), F.col("o_custkey") % 3))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("entry"),
        F.to_date("o_orderdate").alias("date"),
        F.col("o_orderpriority").alias("label"),
        F.concat(F.get(stems, (F.col("o_custkey") % 7).cast("int")), F.get(ends, (F.col("o_orderkey") % 3).cast("int"))).alias("merchant"),
        (cents("o_totalprice") * sign).alias("cents"),
    )


def entries(txn: DataFrame) -> DataFrame:
    """One recurring entry per entity and merchant of the dense transactions."""
    merchant, entity = F.col("merchant"), F.col("entity")
    return (
        txn.groupBy("entry", "entity", "merchant")
        .agg(F.min("date").alias("start_date"), F.max("date").alias("last_date"))
        .select(
            "entry",
            "entity",
            merchant.alias("label"),
            F.when(merchant == "signup", "income").otherwise("spend").alias("direction"),
            F.when(merchant.isin("purchase", "signup"), "standing").otherwise("variable").alias("entry_type"),
            F.when(merchant == "purchase", "max").otherwise("median").alias("rate_method"),
            (entity + 5).cast("int").alias("period_days"),
            F.when(merchant == "error", "pending").otherwise("live").alias("status"),
            F.when(entity == 0, "dow:0").when(entity == 1, "dom:15").when(entity == 2, "interval:14").when(entity == 4, "dom:-1").alias("anchor"),
            "start_date",
            "last_date",
            F.when(entity == 4, F.lit("2024-01-25").cast("date")).alias("end_date"),
        )
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``account, institution, entity, starting`` of every customer."""
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer")
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left")
    return joined.select(F.col("c_custkey").alias("account"), F.col("n_nationkey").alias("institution"), F.col("n_regionkey").alias("entity"), cents("c_acctbal").alias("starting"))


#: The same projections as SQL, for use in front of a query: ``with`` + these.
TXN_SQL = """txn as (select event_id as id, user_id % 5 as entity, user_id as account, cast(ts as date) as date, event_type as merchant,
  cast(user_id % 5 as varchar) || ':' || event_type as entry, cast(round(value * 100) as bigint) * case when event_type = 'signup' then 1 else -1 end as cents from events)"""
ORDERS_SQL = """ord as (select o_orderkey as id, o_custkey as entry, cast(o_orderdate as date) as date, o_orderpriority as label,
  ['Harbour Books', 'Harbour Cafe', 'Lumen Power', 'Tallow & Wick', 'Corner Grocer', 'Ridge View', 'Mill Water'][o_custkey % 7 + 1]
  || ['', ' Com', ' K-' || (o_custkey % 3)][o_orderkey % 3 + 1] as merchant,
  cast(round(o_totalprice * 100) as bigint) * case when o_orderstatus = 'F' then 1 else -1 end as cents from orders)"""
ENTRIES_SQL = """entries as (select entry, entity, merchant as label, case when merchant = 'signup' then 'income' else 'spend' end as direction,
  case when merchant in ('purchase', 'signup') then 'standing' else 'variable' end as entry_type,
  case when merchant = 'purchase' then 'max' else 'median' end as rate_method, cast(entity + 5 as integer) as period_days,
  case when merchant = 'error' then 'pending' else 'live' end as status,
  case entity when 0 then 'dow:0' when 1 then 'dom:15' when 2 then 'interval:14' when 4 then 'dom:-1' end as anchor,
  min(date) as start_date, max(date) as last_date, case when entity = 4 then date '2024-01-25' end as end_date from txn group by entry, entity, merchant)"""
ACCOUNTS_SQL = """accounts as (select c_custkey as account, n_nationkey as institution, n_regionkey as entity, cast(round(c_acctbal * 100) as bigint) as starting
  from customer left join nation on c_nationkey = n_nationkey)"""
