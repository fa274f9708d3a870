"""Assigning transactions to entries by their conditions.

Entries are rows: each has the shape of its tree and the values of its leaves, and meets
those transactions of its entity that an index finds for it (:mod:`.entry_index`). Only
shapes are in the plan, so its size does not depend on how many entries there are.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratewright.checkpoints import cut_lineage
from ratewright.functions import conditions as C
from ratewright.operators import entry_index as index

#: Shapes evaluated in one projection; more are split, as one generated class cannot hold any number.
BATCH = 50
#: Entries that may be broadcast, a few hundred bytes each; beyond it they meet their entity's transactions in a shuffle.
BROADCAST_ENTRIES = 1 << 16
#: The entity of entries that are every entity's; none has this name.
EVERY = "\x00"


@dataclass
class Entry:
    """An entry with its conditions; one without an entity is every entity's."""

    id: str
    tree: dict
    priority: int = 100
    label: str | None = None
    direction: str = "spend"
    entry_type: str = "standing"
    period: int | None = None
    source: str = "user"
    anchor: str | None = None
    rate: float | None = None
    fitness: tuple[float | None, float | None, float | None, float | None] = (None, None, None, None)
    entity: str | None = None


#: Entries with what their conditions are compiled to: ``every`` are the days of an interval anchor, ``access`` is how an index finds them, ``facts`` what the second pass sees.
TABLE = f"entity string, entry string, priority int, label string, shape string, leaf_values array<string>, every int, access {index.ACCESS}, error string, facts {C.MATCHED[6:-1]}"


def _payees(tree: dict) -> dict:
    """The payee leaves at the top of a tree: what makes a partner in an interval, whether or not it meets the rest."""
    return {"op": "AND", "children": [x for x in C.leaves(tree, True) if C.ALIASES.get(x["type"], x["type"]) in C.PAYEE]}


def _compiled(conditions: dict) -> tuple[str | None, list[str] | None, int | None, list[tuple] | None, str | None]:
    """Shape, values, interval and access of a tree, or why it cannot be compiled."""
    try:
        interval = C.interval_of(conditions)
        C.check_tree(conditions)
        return *C.shape_of(conditions), interval, index.access_of(_payees(conditions) if interval else conditions), None
    except (C.ConditionError, ValueError, TypeError) as e:
        return None, None, None, None, str(e)


def entry_table(spark: SparkSession, entries: Iterable[Entry]) -> DataFrame:
    """Entries as a table; those that cannot be compiled have an ``error``."""
    rows = []
    for e in entries:
        facts = (e.id, e.label, e.direction, e.entry_type, e.period, e.source, *e.fitness, e.rate, e.anchor)
        rows.append((e.entity, e.id, e.priority, e.label, *_compiled(e.tree), facts))
    return spark.createDataFrame(rows, TABLE)


def compile_table(entries: DataFrame) -> DataFrame:
    """``entries(entity, entry, priority, label, conditions, facts)``, with trees as JSON, as the table that the passes take."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [_compiled(json.loads(x)) for x in part.pop("conditions")]
            for k, name in enumerate(("shape", "leaf_values", "every", "access", "error")):
                values = [f[k] if name != "access" or f[k] is None else [dict(zip(("branch", "alt", "kind", "value", "low", "high"), key)) for key in f[k]] for f in found]
                part[name] = pd.Series(values, dtype="Int32" if name == "every" else object, index=part.index)
            yield part[["entity", "entry", "priority", "label", "shape", "leaf_values", "every", "access", "error", "facts"]]

    rows = entries.select(F.col("entity").cast("string").alias("entity"), "entry", F.col("priority").cast("int").alias("priority"), "label", "conditions", F.to_json("facts").alias("facts"))
    compiled = rows.mapInPandas(run, TABLE.rsplit(", facts", 1)[0] + ", facts string")
    return compiled.withColumn("facts", F.from_json("facts", C.MATCHED[6:-1]))


def _rows(txns: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transactions with their entity as text, and the sound entries of each entity that they have."""
    entity = F.col("entity").cast("string") if "entity" in txns.columns else F.lit("")
    rows = txns.withColumn("__entity", entity)
    sound = entries.filter("error is null")
    columns = [c for c in sound.columns if c != "entity"]
    shared = sound.filter("entity is null").agg(F.collect_list(F.struct(*columns)).alias("e"))  # one row: entries that are every entity's, a few system ones
    entities = rows.select(F.col("__entity").alias("entity")).distinct()
    shared = entities.crossJoin(F.broadcast(shared)).select("entity", F.inline("e"))
    own = sound.filter("entity is not null").unionByName(shared)
    return rows, own


def _sound(entries: DataFrame) -> DataFrame:
    """The entries that could be compiled, with their entity as a key and their size; written once."""
    bytes_ = F.octet_length("shape") + F.octet_length(F.array_join("leaf_values", ""))
    sound = entries.filter("error is null").withColumn("__entity", F.coalesce("entity", F.lit(EVERY))).drop("entity")
    return cut_lineage(sound.withColumn("__bytes", F.coalesce(bytes_, F.lit(0))))


def _met(rows: DataFrame, sound: DataFrame) -> DataFrame:
    """Transactions with the entries that an index finds for them, whose columns win over those of the same name.

    Entries that are every entity's are looked up among all transactions, as those of one entity.
    """
    shared, keyed = F.col("__entity") == EVERY, F.col("access").isNotNull()
    count = lambda test, name: F.count_if(test).alias(name)
    sums = sound.agg(F.coalesce(F.sum("__bytes"), F.lit(0)).alias("bytes"), count(F.exists("access", lambda k: k["branch"] > 0) | (F.size("access") > F.array_max(F.transform("access", lambda k: k["alt"])) + 1), "several"), count(~shared & keyed, "own_keyed"), count(~shared & ~keyed, "own_plain"), count(shared & keyed, "shared_keyed"), count(shared & ~keyed, "shared_plain"))
    has = sums.first()
    entity = F.col("entity").cast("string") if "entity" in rows.columns else F.lit("")
    columns = [c for c in rows.columns if c not in sound.columns]
    out = []
    for name, mine, key in (("own", ~shared, entity), ("shared", shared, F.lit(EVERY))):
        here = rows.withColumn("__key", key).select(*columns, F.col("__key").alias("__entity"))
        if has[f"{name}_keyed"]:
            out.append(index.candidates(here, sound.filter(mine & keyed), has.several > 0))
        if has[f"{name}_plain"]:
            out.append(index.with_all(here, sound.filter(mine & ~keyed), has.bytes).select(*columns, "__entity", "entry"))
    own = sound.drop("__bytes", "access")
    if not out:
        return rows.select(*columns).join(own, F.lit(False))
    met = functools.reduce(DataFrame.unionByName, out)
    return met.join(F.broadcast(own) if has.bytes <= index.BROADCAST_BYTES else own, ["__entity", "entry"])


def _fit(shapes: list[str], shape: Column, values: Column) -> Column:
    """The fit of a tree of one of some shapes, with interval anchors met."""
    out = F.lit(None).cast("double")
    for known in shapes:
        tree = C.of_shape(known, values)
        out = F.when(shape == known, C.compile_tree(tree, lambda leaf: leaf.get("kind") == "interval")).otherwise(out)
    return out


def _payee_fit(shapes: list[str], shape: Column, values: Column) -> Column:
    """The fit of the payee leaves at the top of a tree."""
    out = F.lit(None).cast("double")
    for known in shapes:
        top = [x for x in C.leaves(C.of_shape(known, values), True) if x["type"] in C.PAYEE]
        out = F.when(shape == known, C.compile_tree({"op": "AND", "children": top})).otherwise(out)
    return out


def _shapes(entries: DataFrame) -> list[list[str]]:
    """Distinct shapes, in batches; people build their trees in a form, so shapes are few however many entries there are."""
    found = sorted(r.shape for r in entries.select("shape").distinct().collect())
    return [found[at : at + BATCH] for at in range(0, len(found), BATCH)]


def interval_chain(candidates: DataFrame, tolerance: int = C.ANCHOR_TOLERANCE) -> DataFrame:
    """Candidates ``(entry, every, id, date, ...)`` with a partner ``every`` days before or after, within the tolerance.

    Days are counted per entry first. A day then looks up the days that its interval
    reaches, an equality join on (entry, day), so no pairs of a group are compared.
    """
    days = candidates.filter("every > 0").select("entry", "every", "date").distinct()
    reach = F.sequence(F.greatest(F.col("every") - (tolerance - 1), F.lit(1)), F.col("every") + (tolerance - 1))
    later = days.select("entry", "date", F.explode(F.transform(reach, lambda k: F.date_add("date", k))).alias("partner"))
    linked = later.join(days.select("entry", F.col("date").alias("partner")), ["entry", "partner"])
    ends = linked.select("entry", "date").unionByName(linked.select("entry", F.col("partner").alias("date"))).distinct()
    return candidates.join(ends, ["entry", "date"], "left_semi")


def first_pass(txns: DataFrame, entries: list[Entry] | DataFrame) -> DataFrame:
    """``(id, entry, fit)``: payee conditions, then timing, then the whole tree; the fit is the least of its parts.

    ``entries``: plan-time ones, or a table as :func:`compile_table` makes it.
    """
    table = entries if isinstance(entries, DataFrame) else entry_table(txns.sparkSession, entries)
    sound = _sound(table)
    met = _met(txns, sound)
    shapes = [_shapes(sound.filter("every is null")), _shapes(sound.filter("every is not null"))]
    met = cut_lineage(met) if sum(map(len, shapes)) > 1 else met
    out = [txns.select("id", F.lit("").alias("entry"), F.lit(1.0).alias("fit")).filter("false")]
    for batch in shapes[0]:
        one = met.filter(F.col("every").isNull() & F.col("shape").isin(batch))
        out.append(one.select("id", "entry", _fit(batch, F.col("shape"), F.col("leaf_values")).alias("fit")).filter("fit is not null"))
    for batch in shapes[1]:
        chained = met.filter(F.col("every").isNotNull() & F.col("shape").isin(batch))
        by_payee = chained.filter(_payee_fit(batch, F.col("shape"), F.col("leaf_values")).isNotNull())
        candidates = by_payee.select("id", "date", "entry", "every", _fit(batch, F.col("shape"), F.col("leaf_values")).alias("fit"))
        out.append(interval_chain(candidates).filter("fit is not null").select("id", "entry", "fit"))
    return functools.reduce(DataFrame.unionByName, out)


def second_pass(txns: DataFrame, matched: DataFrame, first: list[Entry] | DataFrame, second: list[Entry] | DataFrame) -> DataFrame:
    """All assignments ``(id, entry, fit)`` after entries about entries have been matched as often as they can be.

    Rounds follow the reference order: within a round entries look at what the round
    began with, in (priority, id) order; a match whose label the transaction already
    holds is a cycle and ends the transaction's matching. At most one round per entry of
    an entity, each a projection over the transactions' own rows: no shuffle after the
    first grouping. Each round is checkpointed, so its plan does not grow, and rounds end
    when no transaction has news.
    """
    spark = txns.sparkSession
    first, second = (e if isinstance(e, DataFrame) else entry_table(spark, e) for e in (first, second))
    facts = first.select("entry", "facts").dropDuplicates(["entry"])
    known = matched.join(F.broadcast(facts) if facts.count() <= BROADCAST_ENTRIES else facts, "entry", "left")
    held = known.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("entry", "fit", "facts"))).alias("got"))
    rows, own = _rows(txns, second)
    own = cut_lineage(own)
    batches = _shapes(own)
    order = F.array_sort(F.collect_list(F.struct("priority", "entry", "label", "shape", "leaf_values", "facts")))
    of_entity = own.groupBy(F.col("entity").alias("__entity")).agg(order.alias("own"))  # an entity's few entries about entries
    rows = rows.join(held, "id", "left").join(F.broadcast(of_entity) if of_entity.count() <= BROADCAST_ENTRIES else of_entity, "__entity", "left")
    none = F.slice(F.array(F.struct(F.lit("").alias("entry"), F.lit(1.0).alias("fit"), F.lit(None).cast(C.MATCHED[6:-1]).alias("facts"))), 1, 0)
    rows = rows.withColumn("got", F.coalesce("got", none)).withColumn("stopped", F.col("own").isNull())
    most = of_entity.agg(F.max(F.size("own"))).first()[0] or 0
    for _round in range(most):
        rows = cut_lineage(rows.select(*txns.columns, "own", "got", "stopped"))
        if _round and rows.filter("not stopped").isEmpty():
            break
        rows = rows.withColumn("matched", F.array_compact(F.transform("got", lambda g: g["facts"])).cast(C.MATCHED))
        rows = rows.withColumn("labels", F.array_compact(F.transform("matched", lambda m: m["label"])))

        def judged(e: Column) -> Column:
            fits = (_fit(shapes, e["shape"], e["leaf_values"]) for shapes in batches)
            return F.struct(e["entry"].alias("entry"), e["label"].alias("label"), e["facts"].alias("facts"), functools.reduce(lambda a, b: F.coalesce(a, b), fits).alias("fit"))

        # entries that hold already are no news; the first one whose label is held ends the row
        news = F.filter(F.transform("own", judged), lambda s: s["fit"].isNotNull() & ~F.exists("got", lambda g: g["entry"] == s["entry"]))
        rows = rows.withColumn("news", F.when(F.col("stopped"), F.slice(news, 1, 0)).otherwise(news))
        clash = F.expr("array_position(transform(news, s -> coalesce(array_contains(labels, s.label), false)), true)")
        rows = rows.withColumn("clash", clash.cast("int"))
        taken = F.when(F.col("clash") > 0, F.slice("news", F.lit(1), F.col("clash") - 1)).otherwise(F.col("news"))
        fresh = F.transform(taken, lambda s: F.struct(s["entry"].alias("entry"), s["fit"].alias("fit"), s["facts"].alias("facts")))
        rows = rows.withColumn("got", F.concat("got", F.coalesce(fresh, none)))
        rows = rows.withColumn("stopped", F.col("stopped") | (F.col("clash") > 0) | (F.size("news") == 0))
    return rows.select("id", F.explode("got").alias("g")).select("id", "g.entry", "g.fit")


def by_label(assigned: DataFrame, entries: DataFrame) -> DataFrame:
    """Assignments with the label of their entry."""
    return assigned.join(entries.select(F.col("id").alias("entry"), "label"), "entry", "left")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each group."""
    by = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("__k", F.row_number().over(by)).filter("__k = 1").drop("__k")
