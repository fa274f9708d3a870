"""Key-set pages and rankings."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewright.functions.conditions import ConditionError, compile_tree


def after(order: list[tuple[str, bool]], values: list) -> Column:
    """Rows that come after ``values`` in an order of (column, descending) pairs."""
    test, same = F.lit(False), F.lit(True)
    for (name, descending), v in zip(order, values):
        test = test | (same & (F.col(name) < F.lit(v) if descending else F.col(name) > F.lit(v)))
        same = same & (F.col(name) == F.lit(v))
    return test


def page(rows: DataFrame, order: list[tuple[str, bool]], limit: int, cursor: list | None = None) -> DataFrame:
    """The next ``limit`` rows and one more, which tells that there is another page."""
    if cursor:
        rows = rows.filter(after(order, cursor))
    return rows.orderBy(*(F.col(c).desc() if descending else F.col(c).asc() for c, descending in order)).limit(limit + 1)


def cut(rows: list, limit: int, order: list[tuple[str, bool]]) -> tuple[list, list | None]:
    """A collected page without its extra row, and the cursor of the next page."""
    return (rows[:limit], [rows[limit - 1][c] for c, _ in order]) if len(rows) > limit else (rows, None)


def filtered(rows: DataFrame, **equal) -> DataFrame:
    """Only the filters that are given."""
    for name, value in equal.items():
        if value is not None:
            rows = rows.filter(F.col(name).isin(value) if isinstance(value, list) else F.col(name) == F.lit(value))
    return rows


def merchant_search(txns: DataFrame, text: str, limit: int = 50) -> DataFrame:
    return txns.filter(F.lower("merchant").contains(text.lower())).select("merchant").distinct().orderBy("merchant").limit(limit)


def frequent_merchants(txns: DataFrame, limit: int = 50) -> DataFrame:
    return txns.groupBy("merchant").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "merchant").limit(limit)


def matching_any(column: str, patterns: list[str]) -> Column:
    """Whether a column is like one of some patterns, case aside; like none of an empty list."""
    return functools.reduce(operator.or_, (F.col(column).ilike(p) for p in patterns), F.lit(False))


def preview(txns: DataFrame, conditions: dict, limit: int = 200) -> DataFrame:
    """Ids of at most ``limit`` transactions that conditions would take, by id.

    Conditions are a list of patterns under ``merchants``, or a tree of the condition
    language that looks at single transactions; anything else takes none.
    """
    if "merchants" in conditions:
        names = conditions["merchants"]
        fits = matching_any("merchant", [n for n in names if isinstance(n, str)] if isinstance(names, list) else [])
    else:
        try:
            fits = compile_tree(conditions).isNotNull()
        except ConditionError:
            fits = F.lit(False)
    return txns.filter(fits).select("id").orderBy("id").limit(limit)


#: Labels of the system entries in the order they are shown.
SYSTEM_ORDER = ["All", "Income", "Spend"]


def system_place(label: Column) -> Column:
    """Place of a label among the system ones; others come after them."""
    place = F.array_position(F.array(*map(F.lit, SYSTEM_ORDER)), F.coalesce(label, F.lit("")))
    return F.when(place > 0, place - 1).otherwise(len(SYSTEM_ORDER) + 1).cast("int")


def ranked(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows with their ``place`` in the list of their keys, from 1."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
