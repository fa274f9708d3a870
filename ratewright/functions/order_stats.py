"""Order statistics of growing sets: the k-th smallest of all values up to a day.

Two levels of one search. Values fall into blocks by a fixed rule, eight to each doubling,
so that a block of amounts holds few distinct ones. Sums per (day, block) tell the block
that holds the k-th value of a day, and how many lie below it; the same search among the
block's own values then gives the value. What a task holds is days by blocks, or the
equal-counted values of one block, however many rows a key has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks to a doubling of the value, as a power of two.
BITS = 3
#: The block of a day before the first value; no value lies in it.
NO_BLOCK = -(1 << 31)
#: Cells of a table of running counts that are held at a time.
CELLS = 1 << 20


def block_of(value: Column) -> Column:
    """The block of a whole number: its highest bits and how many follow; numbers from 0 have their own sign's blocks in order."""
    size = F.abs(value)
    # bits of the number, counted on its binary text, as no logarithm is exact
    shift = F.greatest(F.length(F.bin(size)) - (BITS + 1), F.lit(0))
    block = shift * (1 << BITS) + F.call_function("shiftright", size, shift)
    return F.when(value < 0, -block).otherwise(block).cast("int")


def kth_upto(day: np.ndarray, value: np.ndarray, n: np.ndarray, ask_day: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each ask the k-th smallest (from 1) of all values up to its day, and how many are smaller than it.

    ``n`` says how often each (day, value) is there. Asks are taken in the order of their
    days, a run of days at a time: one table of running counts over days and values.
    """
    values, place = np.unique(value, return_inverse=True)
    days, at = np.unique(np.concatenate([day, ask_day]), return_inverse=True)
    row_at, ask_at = at[: len(day)], at[len(day) :]
    found, below = np.zeros(len(k), values.dtype if len(values) else np.int64), np.zeros(len(k), np.int64)
    base = np.zeros(len(values), np.int64)
    rows, asks = np.argsort(row_at, kind="stable"), np.argsort(ask_at, kind="stable")
    step = max(1, CELLS // max(1, len(values)))
    for first in range(0, len(days), step):
        size = min(step, len(days) - first)
        here = rows[np.searchsorted(row_at[rows], first) : np.searchsorted(row_at[rows], first + size)]
        table = np.zeros((size, len(values)), np.int64)
        np.add.at(table, (row_at[here] - first, place[here]), n[here])
        table[0] += base
        np.cumsum(table, axis=0, out=table)
        base = table[-1].copy()
        mine = asks[np.searchsorted(ask_at[asks], first) : np.searchsorted(ask_at[asks], first + size)]
        upto = np.cumsum(table, axis=1)[ask_at[mine] - first]
        j = (upto >= k[mine, None]).argmax(1)
        found[mine] = values[j]
        below[mine] = np.where(j > 0, upto[np.arange(len(mine)), np.maximum(j - 1, 0)], 0)
    return found, below


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def _asks(counts: pa.Table) -> pa.Table:
    """Both middles of each day of a key: the block that holds each, and its place in there; with the day's running maximum. No block before the first value."""
    day, n = _column(counts, "day"), _column(counts, "n")
    none = np.iinfo(np.int64).min
    days, at = np.unique(day, return_inverse=True)
    upto = np.cumsum(np.bincount(at, weights=n)).astype(np.int64)
    most = np.full(len(days), none)
    np.maximum.at(most, at, counts["most"].combine_chunks().fill_null(none).to_numpy())
    most = np.maximum.accumulate(most)
    ask_day, k = np.concatenate([days, days]), np.concatenate([(upto + 1) // 2, upto // 2 + 1])
    block, below = kth_upto(day, _column(counts, "block"), n, ask_day, k)
    key, empty = pa.array([counts["key"][0].as_py()] * len(k), counts.schema.field("key").type), np.concatenate([upto, upto]) == 0
    return pa.table({"key": key, "day": pa.array(ask_day), "block": pa.array(np.where(empty, NO_BLOCK, block), pa.int32()), "k": pa.array(k - below), "most": pa.array(np.concatenate([most, most]), mask=empty)})


def _answers(rows: pa.Table, asks: pa.Table) -> pa.Table:
    if rows.num_rows:
        value = pa.array(kth_upto(_column(rows, "day"), _column(rows, "value"), _column(rows, "n"), _column(asks, "day"), _column(asks, "k"))[0], pa.int64())
    else:
        value = pa.nulls(asks.num_rows, pa.int64())
    return pa.table({"key": asks["key"], "day": asks["day"], "value": value, "most": asks["most"]})


def expanding_medians(counts: DataFrame, key: str, day: str, value: str, n: str) -> DataFrame:
    """``(key, day, median, max)`` of all values up to each day of a key that has one; the mean of two middles is cut to a whole number.

    ``counts`` has a row per (key, day, value) that says how often it is there; days are whole
    numbers; a null key is a key, and a day with null values alone has what was there before. Its plan is read twice, as one exchange that Spark uses again.
    """
    given = F.col(value).isNotNull()
    amount = F.when(given, F.col(value)).cast("bigint")
    rows = counts.select(F.col(key).alias("key"), F.col(day).cast("int").alias("day"), amount.alias("most"), F.coalesce(amount, F.lit(0)).alias("value"), F.when(given, F.col(n)).otherwise(0).cast("bigint").alias("n"))
    rows = rows.withColumn("block", block_of(F.col("value")))
    kind = rows.schema["key"].dataType.simpleString()
    by_block = rows.groupBy("key", "day", "block").agg(F.sum("n").alias("n"), F.max("most").alias("most"))
    asks = by_block.groupBy("key").applyInArrow(_asks, f"key {kind}, day int, block int, k bigint, most bigint")
    met = rows.groupBy("key", "block").cogroup(asks.groupBy("key", "block"))
    found = met.applyInArrow(_answers, f"key {kind}, day int, value bigint, most bigint")
    middles = found.groupBy("key", "day").agg(F.min("value").alias("__low"), F.max("value").alias("__high"), F.max("most").alias("max"))
    return middles.select(F.col("key").alias(key), F.col("day").alias(day), F.expr("__low + (__high - __low) div 2").alias("median"), "max")
