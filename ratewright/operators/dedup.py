"""De-duplication of imported transactions against stored ones, in five passes."""

from __future__ import annotations

import functools
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewright.checkpoints import cut_lineage
from ratewright.functions.dates import effective_status
from ratewright.functions.money import within_tolerance
from ratewright.functions.text import lcs_ratio

#: Least share of a common subsequence for names that count as the same.
SIMILAR = 0.70
#: Pairs of a piece that one task solves, at most.
PIECE_PAIRS = 100_000
#: Rows that agree in these are equals; any of them answers for any other.
EQUAL = ["account", "merchant", "date", "cents"]


def _days(date: Column, days: int) -> Column:
    """Number of the stretch of days that a date lies in; it is twice as long as a band."""
    return F.floor(F.unix_date(date) / (2 * (2 * days + 1)))


def _amounts(cents: Column, share: float) -> Column:
    """Number of the stretch of amounts that one lies in, never less for a larger amount.

    Stretches grow with the amount: the ends of each are as far apart as those of two bands in a row.
    """
    band = max(share, 1e-4)  # wider stretches lose nothing
    width = 2 * (math.log1p(band) - math.log1p(-band))
    return F.when(cents == 0, F.lit(0).cast("bigint")).otherwise(F.signum(cents).cast("bigint") * (1 + F.floor(F.ln(F.abs(cents)) / width)))


def _band_join(candidates: DataFrame, stored: DataFrame, keys: list[str], days: int, share: float) -> DataFrame:
    """Pairs with equal keys whose dates are within ``days`` and amounts within a share.

    A stored row lies in one stretch of days and one of amounts. Both are twice as long as a band, so a
    candidate goes to one or two of each, however wide the band is, and the join is one of equal
    (keys, days, amounts): its cost follows the matches, not the history of an account
    nor the rows of a busy day. The join sorts, as the statistics of a plan do not count the copies.
    """
    cents, spread = F.col("cents").cast("bigint"), candidates
    there = stored.select(*keys, F.col("date").alias("s_date"), F.col("id").alias("s_id"), F.col("cents").alias("s_cents"), F.col("merchant").alias("s_merchant"), F.col("settlement_status").alias("s_status"))
    there = there.withColumn("__days", _days(F.col("s_date"), days))
    on = [*keys, "__days"]
    if share < 1:  # else a band may reach down to nothing, and every stretch with it
        tolerance = F.floor(F.abs(cents) * share).cast("bigint")
        spread = spread.withColumn("__amounts", F.explode(F.sequence(_amounts(cents - tolerance, share), _amounts(cents + tolerance, share))))
        there = there.withColumn("__amounts", _amounts(F.col("s_cents").cast("bigint"), share))
        on.append("__amounts")
    spread = spread.withColumn("__days", F.explode(F.sequence(_days(F.date_sub("date", days), days), _days(F.date_add("date", days), days))))
    met = spread.join(there.hint("merge"), on).drop("__days", "__amounts")
    return met.filter((F.abs(F.date_diff("date", "s_date")) <= days) & within_tolerance(F.col("cents"), F.col("s_cents"), share))


def _may_be_similar(a: Column, b: Column) -> Column:
    """Whether two names can have a common subsequence of the least share: no longer than the shorter, nor than what letters they share."""
    longer, shorter = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))

    def count(text: Column, letter: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, letter, F.lit("")))

    letters = F.array_distinct(F.filter(F.split(a, ""), lambda c: c != ""))
    shared = F.aggregate(letters, F.lit(0), lambda n, c: n + F.least(count(a, c), count(b, c)))
    return F.when(shorter < longer * SIMILAR, False).otherwise(shared >= longer * SIMILAR)


def _equals(rows: DataFrame, number: str) -> DataFrame:
    """Rows with the ``first`` of their equals, how many (``n``) these are, and the place ``k`` among them."""
    equal = Window.partitionBy(*EQUAL)
    k = F.row_number().over(equal.orderBy(number)) - 1
    return cut_lineage(rows.withColumn("k", k).withColumn("first", F.min(number).over(equal)).withColumn("n", F.count("*").over(equal)))


def _pairing(pairs: DataFrame) -> DataFrame:
    """Pairs of groups of equals, nearest first, as far as both still have rows: ``(c_first, s_first, pass, c_from, s_from, take)``.

    A round takes the pairs that are the nearest one to both sides; each uses up one
    side, what the other has left goes on to the next round. Rounds end with the pairs.
    """
    left = pairs.withColumn("c_from", F.lit(0).cast("bigint")).withColumn("s_from", F.lit(0).cast("bigint"))
    taken = []
    while True:
        of_c, of_s = Window.partitionBy("c_first"), Window.partitionBy("s_first")
        order = ("pass", "distance", "s_first", "c_first")
        both = left.withColumn("__c", F.row_number().over(of_c.orderBy(*order))).withColumn("__s", F.row_number().over(of_s.orderBy(*order)))
        both = both.withColumn("take", F.when((F.col("__c") == 1) & (F.col("__s") == 1), F.least("n", "m"))).drop("__c", "__s")
        both = both.withColumn("s_lost", F.coalesce(F.sum("take").over(of_s), F.lit(0))).withColumn("c_lost", F.coalesce(F.sum("take").over(of_c), F.lit(0)))
        both = cut_lineage(both)
        taken.append(both.filter("take is not null").select("c_first", "s_first", "pass", "c_from", "s_from", "take"))
        left = both.filter("n > c_lost and m > s_lost").select(
            "c_first", "s_first", "pass", "distance", *((F.col(a) - F.col(b)).alias(a) for a, b in (("n", "c_lost"), ("m", "s_lost"))), *((F.col(a) + F.col(b)).alias(a) for a, b in (("c_from", "c_lost"), ("s_from", "s_lost")))
        )
        if left.isEmpty():
            return functools.reduce(DataFrame.unionByName, taken)


def _take(pairs: pa.Table) -> pa.Table:
    """All pairs of a piece, nearest first, each taking what both sides have left: what :func:`_pairing` does in rounds."""
    rows = pairs.sort_by([(c, "ascending") for c in ("pass", "distance", "s_first", "c_first")]).to_pylist()
    c_used: dict = {}
    s_used: dict = {}
    out = []
    for r in rows:
        c, s = c_used.get(r["c_first"], 0), s_used.get(r["s_first"], 0)
        take = min(r["n"] - c, r["m"] - s)
        if take > 0:
            out.append((r["c_first"], r["s_first"], r["pass"], c, s, take))
            c_used[r["c_first"]], s_used[r["s_first"]] = c + take, s + take
    fields = [pairs.schema.field("c_first"), pairs.schema.field("s_first"), pairs.schema.field("pass"), ("c_from", pa.int64()), ("s_from", pa.int64()), ("take", pa.int64())]
    columns = list(zip(*out)) or [()] * 6
    return pa.table([pa.array(c, f.type if isinstance(f, pa.Field) else f[1]) for c, f in zip(columns, fields)], names=["c_first", "s_first", "pass", "c_from", "s_from", "take"])


def _pieces(rows: DataFrame, days: int, share: float) -> DataFrame:
    """``(account, date, cents, piece)``: pieces that no pair crosses, as between them lie more days, or more cents, than a pair may be apart.

    Only distinct days of an account, and distinct amounts of a run of days, are ordered.
    """
    by_day = Window.partitionBy("account").orderBy("date")
    dates = rows.select("account", "date").distinct().withColumn("new", F.date_diff("date", F.lag("date").over(by_day)) > days)
    dates = dates.select("account", "date", F.sum(F.coalesce(F.col("new").cast("int"), F.lit(0))).over(by_day).alias("run"))
    by_amount = Window.partitionBy("account", "run").orderBy("cents")
    before = F.lag("cents").over(by_amount)
    apart = F.col("cents") - before > F.floor(F.greatest(F.abs("cents"), F.abs(before)) * share)
    amounts = rows.join(dates, ["account", "date"]).select("account", "run", "cents").distinct().withColumn("new", apart)
    amounts = amounts.select("account", "run", "cents", F.sum(F.coalesce(F.col("new").cast("int"), F.lit(0))).over(by_amount).alias("step"))
    return rows.join(dates, ["account", "date"]).join(amounts, ["account", "run", "cents"]).select("account", "date", "cents", F.struct("account", "run", "step").alias("piece"))


_TAKEN = "c_first {c_first}, s_first {s_first}, pass {pass}, c_from bigint, s_from bigint, take bigint"


def _assigned(pairs: DataFrame, groups: DataFrame, there: DataFrame, days: int, share: float) -> DataFrame:
    """Pairs taken, piece by piece in one pass; a piece with more than :data:`PIECE_PAIRS` pairs is solved in rounds of plans instead, to the same end.

    Pieces are independent, so many small ones are solved together; when all pairs are no more than one task solves, they need not be told apart.
    """
    pairs = cut_lineage(pairs)
    schema = _TAKEN.format(**{c: pairs.schema[c].dataType.simpleString() for c in ("c_first", "s_first", "pass")})
    if pairs.count() <= PIECE_PAIRS:
        return pairs.groupBy(F.lit(0).alias("lot")).applyInArrow(_take, schema)
    where = _pieces(groups.select("account", "date", "cents").unionByName(there.select("account", "date", "cents")).distinct(), days, share)
    placed = groups.join(where, ["account", "date", "cents"]).select(F.col("first").alias("c_first"), "piece")
    pairs = pairs.join(placed, "c_first")
    sized = cut_lineage(pairs.join(pairs.groupBy("piece").agg(F.count("*").alias("pairs")), "piece"))
    small, large = sized.filter(F.col("pairs") <= PIECE_PAIRS), sized.filter(F.col("pairs") > PIECE_PAIRS).drop("piece", "pairs")
    total = sized.agg(F.count_if(F.col("pairs") <= PIECE_PAIRS).alias("small"), F.count_if(F.col("pairs") > PIECE_PAIRS).alias("large")).first()
    lots = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total.small // PIECE_PAIRS + 1)
    taken = small.groupBy(F.pmod(F.xxhash64("piece"), F.lit(lots)).alias("lot")).applyInArrow(_take, schema)
    return taken.unionByName(_pairing(large)) if total.large else taken


def classify(candidates: DataFrame, stored: DataFrame, days: int = 3, share: float = 0.005, settlement_window: int = 14) -> DataFrame:
    """``(row, pass, stored_id, action)`` for each candidate: insert, skip or supersede.

    Both tables hold ``account, date, cents, merchant, imported_id``; candidates are
    numbered by ``row``, stored rows by ``id`` with their ``settlement_status``. The
    first pass that hits decides: equal imported id; beyond the stored dates; equal
    merchant in the band; similar merchant in the band; none. A stored row answers one
    candidate only. Pairs are taken by pass, then by distance; whoever loses a row to
    another takes the nearest one still free, and equal rows meet one to one.
    """
    same_id = Window.partitionBy("account", "imported_id")
    known = stored.filter("imported_id is not null").select("account", "imported_id", F.col("id").alias("s_id"), F.col("date").alias("s_date"), F.col("settlement_status").alias("s_status"))
    known = known.withColumn("k", F.row_number().over(same_id.orderBy("s_id")))
    exact = candidates.filter("imported_id is not null").withColumn("k", F.row_number().over(same_id.orderBy("row"))).join(known, ["account", "imported_id", "k"])
    exact = cut_lineage(exact.select("row", F.lit(1).alias("pass"), "s_id", "s_date", "s_status"))
    by_account = stored.groupBy("account").agg(F.max("date").alias("boundary"))
    dated = candidates.join(by_account, "account", "left")
    inside = dated.filter(F.col("date") <= F.date_add("boundary", days)).join(exact, "row", "left_anti")
    mine = _equals(inside.select(*EQUAL, "row"), "row")
    theirs = _equals(stored.join(exact.select(F.col("s_id").alias("id")), "id", "left_anti").select(*EQUAL, "id", "settlement_status"), "id")
    groups, there = mine.filter("k = 0"), theirs.filter("k = 0")
    # one join for both passes: equal names need no comparison, and a null instead of them none in Python
    equal = F.col("merchant") == F.col("s_merchant")
    near = _band_join(groups, there, ["account"], days, share).withColumn("equal", equal)
    near = near.withColumn("a", F.when(~F.col("equal"), F.lower("merchant"))).withColumn("b", F.when(~F.col("equal"), F.lower("s_merchant")))
    near = near.filter(F.col("equal") | _may_be_similar(F.col("a"), F.col("b"))).filter(F.col("equal") | (lcs_ratio(F.col("a"), F.col("b")) >= SIMILAR)).drop("a", "b")

    distance = F.abs(F.date_diff("date", "s_date")) * F.lit(1 << 40) + F.abs(F.col("cents") - F.col("s_cents"))
    tagged = near.select(F.col("first").alias("c_first"), F.col("s_id").alias("s_first"), F.when(F.col("equal"), 3).otherwise(4).alias("pass"), distance.alias("distance"), "n")

    sizes = there.select(F.col("first").alias("s_first"), F.col("n").alias("m"))
    taken = cut_lineage(_assigned(tagged.join(sizes, "s_first"), groups, there, days, share))

    def slots(rows: DataFrame, side: str, *columns: Column) -> DataFrame:
        slot = F.col("k") - F.col(f"{side}_from")
        of = rows.withColumnRenamed("first", f"{side}_first").join(taken, f"{side}_first").withColumn("slot", slot)
        return of.filter("slot >= 0 and slot < take").select("c_first", "s_first", "slot", *columns)

    stored_slots = slots(theirs, "s", F.col("id").alias("s_id"), F.col("date").alias("s_date"), F.col("settlement_status").alias("s_status"))
    met = slots(mine, "c", F.col("row"), F.col("pass")).join(stored_slots, ["c_first", "s_first", "slot"])
    best = exact.unionByName(met.select("row", "pass", "s_id", "s_date", "s_status"))
    latest = candidates.agg(F.max("date").alias("anchor"))  # one row
    best = best.crossJoin(F.broadcast(latest))
    age = effective_status(F.col("s_status"), F.col("s_date"), F.col("anchor"), F.lit(settlement_window))
    found = best.select("row", "pass", F.col("s_id").alias("stored_id"), F.when(age == "young_flux", "supersede").otherwise("skip").alias("action"))
    rest = dated.join(found, "row", "left_anti").select("row", F.when(F.col("boundary").isNull() | (F.col("date") > F.date_add("boundary", days)), 2).otherwise(5).alias("pass"))
    return found.unionByName(rest.select("row", "pass", F.lit(None).cast(stored.schema["id"].dataType).alias("stored_id"), F.lit("insert").alias("action")))


def apply(candidates: DataFrame, stored: DataFrame, actions: DataFrame) -> DataFrame:
    """The stored table after an import: superseded rows go, inserted and superseding ones come in as flux."""
    gone = actions.filter("action = 'supersede'").select(F.col("stored_id").alias("id"))
    fresh = candidates.join(actions.filter("action <> 'skip'").select("row"), "row", "left_semi").withColumn("settlement_status", F.lit("flux"))
    kept = stored.join(gone, "id", "left_anti")
    return kept.unionByName(fresh.select(F.col("row").alias("id"), *(c for c in stored.columns if c != "id")))


def counts(actions: DataFrame) -> DataFrame:
    """One row for the import batch: imported, skipped and superseded."""
    def of(*names: str) -> Column:
        return F.count_if(F.col("action").isin(*names))

    return actions.agg(of("insert", "supersede").alias("imported"), of("skip").alias("skipped"), of("supersede").alias("superseded"))
