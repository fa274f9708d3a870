"""Which entries a transaction can belong to, found by index instead of by trying them all.

Each entry has an access: for each branch of an OR at its top (one, if there is no OR)
alternative sets of leaves, of each of which every match of the branch must meet one. Equal names and accounts are join keys. Parts of names are looked up by the
rarest of their three-letter pieces, ranges by the aligned blocks that they are made of.
Lookups run over distinct names, amounts and days of an entity, not over transactions, and
tell how many transactions each alternative lets through; the least one of a branch is
taken, and its names and values meet the transactions in an equality join. Only entries without an access
meet all transactions.
"""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.checkpoints import cut_lineage
from ratewright.functions.conditions import ALIASES

#: Type of an entry's access, keys by branch of the OR at the top and alternative there; null is none, an empty one is a tree without matches.
ACCESS = "array<struct<branch:int,alt:int,kind:string,value:string,low:bigint,high:bigint>>"
#: Letters of a piece of a name, and bits of the widest block of a range; amounts are below half of that.
PIECE, LEVELS = 3, 62
#: Entries without an access that are sent to all tasks, in bytes of their text; more are joined in a shuffle, in so many copies.
BROADCAST_BYTES, COPIES = 16 << 20, 64

Key = tuple[str, str | None, int | None, int | None]
#: Kinds of keys by how few matches they let through, for the branches of an OR, which are not counted out.
_RANK = {"exact": 0, "part": 1, "start": 1, "end": 1, "account": 2, "cents": 3, "institution": 4, "day": 5}
_PARTS = {"payee_contains": "part", "payee_starts_with": "start", "payee_ends_with": "end"}
_LIMIT = 1 << LEVELS - 1


def _days(text: object) -> int:
    return (dt.date.fromisoformat(str(text)) - dt.date(1970, 1, 1)).days


def _of_leaf(leaf: dict) -> list[Key] | None:
    kind, value = ALIASES.get(leaf.get("type"), leaf.get("type")), leaf.get("value")
    if kind == "payee_exact":
        return [("exact", str(value), None, None)]
    if kind == "imported_payee_one_of":
        return [("exact", str(v), None, None) for v in value] if isinstance(value, list) else None
    if kind in _PARTS and str(value):
        return [(_PARTS[kind], str(value), None, None)]
    if kind in ("account_id", "institution_id"):
        return [(kind.removesuffix("_id"), str(value), None, None)]
    try:
        if kind == "amount_range" and (leaf.get("min_cents") is not None or leaf.get("max_cents") is not None):
            low, high = leaf.get("min_cents"), leaf.get("max_cents")
            low, high = -_LIMIT if low is None else int(low), _LIMIT - 1 if high is None else int(high)
            return [("cents", None, low, high)] if -_LIMIT <= low and high < _LIMIT else None
        if kind == "date_range":
            return [("day", None, _days(leaf["start"]), _days(leaf["end"]))]
    except (ValueError, TypeError):
        return None  # left to the tree itself
    return None


def _worth(keys: list[Key]) -> tuple[int, int]:
    """Less is better: the kind that lets most through, and how wide the whole is."""
    open_ended = any(k == "cents" and (low == -_LIMIT or high == _LIMIT - 1) for k, _, low, high in keys)
    return max((_RANK[k[0]] + (4 if open_ended else 0) for k in keys), default=-1), len(keys)


def _alternatives(tree: dict) -> list[list[Key]]:
    """Sets of keys; every match of a tree has a key of each set."""
    op, children = tree.get("op"), tree.get("children") or []
    if op is None:
        keys = _of_leaf(tree)
        return [] if keys is None else [keys]
    if op == "AND":
        return [keys for c in children for keys in _alternatives(c)]
    if op in ("OR", "XOR"):
        best = [min(found, key=_worth, default=None) for found in map(_alternatives, children)]
        return [] if None in best else [list(dict.fromkeys(k for keys in best for k in keys))]
    return []


def access_of(tree: dict) -> list[tuple] | None:
    """The access of a tree, or None; an empty one is that of a tree without matches."""
    branches = tree.get("children") or [] if tree.get("op") in ("OR", "XOR") else [tree]
    found = [_alternatives(b) for b in branches]
    if [] in found:
        return None
    return [(n, alt, *key) for n, sets in enumerate(found) if [] not in sets for alt, keys in enumerate(sets) for key in keys]


def blocks_of(low: Column, high: Column) -> Column:
    """The aligned blocks ``(level, block)`` that make up a range of whole numbers, at most two to a level."""
    # from below: a block at each level where the low end is odd; from above likewise; until the ends meet
    levels = F.sequence(F.lit(0), F.lit(LEVELS))

    def ends(state: Column, level: Column) -> Column:
        lo, hi, open_ = state["lo"], state["hi"], state["lo"] <= state["hi"]
        odd, even = open_ & (F.pmod(lo, F.lit(2)) == 1), open_ & (F.pmod(hi, F.lit(2)) == 0)
        block = lambda b: F.struct(level.alias("level"), b.alias("block"))
        none = F.array().cast("array<struct<level:int,block:bigint>>")
        taken = F.concat(state["got"], F.when(odd, F.array(block(lo))).otherwise(none), F.when(even & ~(odd & (lo == hi)), F.array(block(hi))).otherwise(none))
        lo2 = F.call_function("shiftright", F.when(odd, lo + 1).otherwise(lo), F.lit(1))
        hi2 = F.call_function("shiftright", F.when(even, hi - 1).otherwise(hi), F.lit(1))
        return F.struct(F.when(open_, lo2).otherwise(lo).alias("lo"), F.when(open_, hi2).otherwise(hi).alias("hi"), taken.alias("got"))

    start = F.struct(low.cast("bigint").alias("lo"), high.cast("bigint").alias("hi"), F.array().cast("array<struct<level:int,block:bigint>>").alias("got"))
    return F.aggregate(levels, start, ends, lambda s: s["got"])


def pieces_of(text: Column, size: Column) -> Column:
    """All distinct pieces of ``size`` letters of a text."""
    last = F.length(text) - size + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, size))))


def _parts(keys: DataFrame, names: DataFrame) -> DataFrame:
    """Keys by name, for parts of names: pieces that no name has end the search, else the rarest one is looked up."""
    needles = keys.filter(F.col("kind").isin("part", "start", "end")).select("__entity", "entry", "branch", "alt", "kind", F.lower("value").alias("needle")).distinct()
    needles = needles.withColumn("size", F.least(F.length("needle"), F.lit(PIECE)))
    sizes = needles.select("__entity", "size").distinct()
    held = names.join(sizes, "__entity").select("__entity", "size", "__text", "n", F.explode(pieces_of(F.col("__text"), F.col("size"))).alias("piece"))
    often = held.groupBy("__entity", "size", "piece").agg(F.count("*").alias("often"))
    asked = needles.withColumn("piece", F.explode(pieces_of(F.col("needle"), F.col("size")))).join(often, ["__entity", "size", "piece"], "left")
    rarest = asked.groupBy("__entity", "entry", "branch", "alt", "kind", "needle", "size").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "piece")).alias("r"))
    rarest = rarest.filter("r.often > 0").select("__entity", "entry", "branch", "alt", "kind", "needle", "size", F.col("r.piece").alias("piece"))
    met = held.join(rarest, ["__entity", "size", "piece"])
    text, needle = F.col("__text"), F.col("needle")
    return met.filter(F.when(F.col("kind") == "part", text.contains(needle)).when(F.col("kind") == "start", text.startswith(needle)).otherwise(text.endswith(needle)))


def _equal(keys: DataFrame, texts: DataFrame, value: Column) -> DataFrame:
    """Keys by text, for equal ones."""
    return keys.select("__entity", value.alias("__text"), "entry", "branch", "alt").distinct().join(texts, ["__entity", "__text"])


def _ranges(keys: DataFrame, values: DataFrame) -> DataFrame:
    """Keys by value, for ranges: a value lies in one block of each level, a range is made of blocks."""
    asked = keys.filter("low <= high").select("__entity", "entry", "branch", "alt", F.explode(blocks_of(F.col("low"), F.col("high"))).alias("b"))
    asked = asked.select("__entity", "entry", "branch", "alt", F.col("b.level").alias("level"), F.col("b.block").alias("block"))
    levels = asked.select("__entity", "level").distinct()
    there = values.join(levels, "__entity").withColumn("block", F.call_function("shiftright", F.col("__at"), F.col("level")))
    return there.join(asked, ["__entity", "level", "block"])


#: What keys of each kind are compared with: a text or a whole number of the transaction.
_COLUMNS = {
    "name": ("__text", lambda: F.lower("merchant")), "account": ("__text", lambda: F.col("account").cast("string")), "institution": ("__text", lambda: F.col("institution").cast("string")),
    "cents": ("__at", lambda: F.col("cents").cast("bigint")), "day": ("__at", lambda: F.unix_date(F.col("date")).cast("bigint")),
}


def _lookups(rows: DataFrame, keys: DataFrame) -> list[tuple[str, DataFrame]]:
    """By column, ``(__entity, value, entry, branch, alt, n)``: the values that have a key, and how many transactions have the value."""
    kinds = {r.kind for r in keys.select("kind").distinct().collect()}  # seven at most
    out = []
    for column, (at, value) in _COLUMNS.items():
        mine = kinds & {"exact", "part", "start", "end"} if column == "name" else kinds & {column}
        if not mine:
            continue
        values = rows.select("__entity", value().alias(at)).filter(F.col(at).isNotNull()).groupBy("__entity", at).agg(F.count("*").alias("n"))
        if column == "name":
            found = [_equal(keys.filter("kind = 'exact'"), values, F.lower("value"))] if "exact" in mine else []
            found += [_parts(keys, values)] if mine - {"exact"} else []
        elif at == "__text":
            found = [_equal(keys.filter(F.col("kind") == column), values, F.col("value"))]
        else:
            found = [_ranges(keys.filter(F.col("kind") == column), values)]
        pairs = functools.reduce(DataFrame.unionByName, (p.select("__entity", at, "entry", "branch", "alt", "n") for p in found))
        out.append((column, cut_lineage(pairs.distinct())))
    return out


def candidates(rows: DataFrame, entries: DataFrame, several: bool = True) -> DataFrame:
    """``rows`` with the ``entry`` of each access of their ``__entity`` that they have; a row meets an entry once.

    ``entries(__entity, entry, access)`` all have an access. ``several``: some have several
    branches, or alternatives of several keys, so that a row may find an entry twice.
    """
    keys = entries.select("__entity", "entry", F.inline("access"))
    lookups = _lookups(rows, keys)
    columns = rows.columns
    if not lookups:
        return rows.select(*columns, F.lit("").alias("entry")).filter("false")
    sums = functools.reduce(DataFrame.unionByName, (pairs.groupBy("__entity", "entry", "branch", "alt").agg(F.sum("n").alias("n")) for _, pairs in lookups))
    cost = keys.select("__entity", "entry", "branch", "alt").distinct().join(sums, ["__entity", "entry", "branch", "alt"], "left").groupBy("__entity", "entry", "branch", "alt").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    chosen = cut_lineage(cost.groupBy("__entity", "entry", "branch").agg(F.min(F.struct("n", "alt")).alias("c")).select("__entity", "entry", "branch", "c.alt"))
    out = []
    for column, pairs in lookups:
        at, value = _COLUMNS[column]
        taken = pairs.join(chosen, ["__entity", "entry", "branch", "alt"], "left_semi").select("__entity", at, "entry").distinct()
        out.append(rows.withColumn(at, value()).join(taken, ["__entity", at]).select(*columns, "entry"))
    met = functools.reduce(DataFrame.unionByName, out)
    return met.dropDuplicates(["id", "entry"]) if several and len(out) > 1 else met


def with_all(rows: DataFrame, entries: DataFrame, size: int) -> DataFrame:
    """Rows with every entry of their ``__entity``; ``size``: the bytes of these entries, or more."""
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(entries.select("__entity", "entry")), "__entity")
    salt = F.pmod(F.xxhash64("id"), F.lit(COPIES))
    copies = entries.select("__entity", "entry", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).cast("bigint").alias("__salt"))
    return rows.withColumn("__salt", salt).join(copies, ["__entity", "__salt"]).drop("__salt")
