"""Whole cents: parsing, signs, tolerances and exact medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AMOUNT = r"\A-?([0-9]+)(?:\.([0-9]*))?\z"


def parse_cents(amount: Column) -> Column:
    """Cents of a decimal text; digits after the second are cut off, not rounded.

    White space and commas are ignored. Null where there is no whole part, or any other sign.
    """
    plain = F.regexp_replace(amount, r"[\s,]", "")
    whole, fraction = F.regexp_extract(plain, _AMOUNT, 1), F.regexp_extract(plain, _AMOUNT, 2)
    cents = F.concat(whole, F.rpad(F.substring(fraction, 1, 2), 2, "0")).try_cast("bigint")
    return F.when(whole != "", F.when(plain.startswith("-"), -cents).otherwise(cents))


def with_sign(cents: Column, convention: str = "positive_is_credit") -> Column:
    """Inflow positive, outflow negative, whichever way the file has it."""
    return -cents if convention == "positive_is_debit" else cents


def within_tolerance(a: Column, b: Column, share: float) -> Column:
    """Whether two amounts differ by at most the whole cents in a share of the first."""
    return F.abs(a - b) <= F.floor(F.abs(a) * share)


def sorted_median(amounts: Column) -> Column:
    """Exact median of a sorted array of longs; the mean of two middles is cut to whole cents."""
    n = F.size(amounts)
    upper = F.try_element_at(amounts, (n / 2).cast("int") + 1)
    lower = F.try_element_at(amounts, ((n + 1) / 2).cast("int"))
    both = lower + upper
    return F.when(n % 2 == 1, upper).when(n > 0, F.signum(both).cast("bigint") * F.floor(F.abs(both) / 2))


def grouped_median(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Exact median of ``value`` per group, without a list of a group's values anywhere.

    Equal values are counted before the shuffle; running counts then find both middles.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    by_value = Window.partitionBy(*keys).orderBy(value)
    ranked = counts.select(*keys, value, F.sum("__n").over(by_value).alias("__upto"), F.sum("__n").over(Window.partitionBy(*keys)).alias("__all"))
    middle = ranked.groupBy(*keys).agg(
        F.min(F.expr(f"case when __upto >= (__all + 1) div 2 then {value} end")).alias("__low"),
        F.min(F.expr(f"case when __upto >= __all div 2 + 1 then {value} end")).alias("__high"),
    )
    return middle.select(*keys, F.expr("(__low + __high) div 2").alias(name))
