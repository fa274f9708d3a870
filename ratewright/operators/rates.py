"""Daily rates, trends and snapshots of entries and labels, as one grid and its windows.

The grid holds a row per entry and day of its life. Transactions are added up per
entry and day before anything is joined, so no window sees more rows than days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewright.checkpoints import cut_lineage
from ratewright.functions.order_stats import expanding_medians
from ratewright.functions.rates import actual_rate, drift, sign_of, window_days

_EPOCH = "1970-01-01"


def daily(txns: DataFrame, key: str = "entry") -> DataFrame:
    return txns.groupBy(key, "date").agg(F.sum("cents").alias("cents"), F.count("*").alias("n"))


def grid(entries: DataFrame, as_of: Column) -> DataFrame:
    """A row per entry and day from its start to its end or ``as_of``."""
    last = F.least(F.coalesce("end_date", as_of), as_of)
    return entries.filter(F.col("start_date") <= last).withColumn("date", F.explode(F.sequence(F.col("start_date"), last)))


def as_of(txns: DataFrame) -> DataFrame:
    """One row: the last date of all transactions, which counts as today."""
    return txns.agg(F.max("date").alias("as_of"))


def _day(day: Column) -> Column:
    return F.date_diff(day, F.lit(_EPOCH).cast("date"))


def rolling(days: DataFrame, window: int, keys: tuple[str, ...] = ("entry",)) -> DataFrame:
    """A grid with the sums of the last ``window`` days, both ends included, and the first day with a transaction."""
    by = Window.partitionBy(*keys).orderBy("__day")
    last = by.rangeBetween(-window, 0)
    out = days.withColumn("__day", _day(F.col("date")))
    return out.select(
        *days.columns,
        F.coalesce(F.sum("cents").over(last), F.lit(0)).alias("total"),
        F.coalesce(F.sum("n").over(last), F.lit(0)).alias("count"),
        F.min(F.when(F.col("n") > 0, F.col("date"))).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("earliest"),
    )


def rolling_by_entry(days: DataFrame, window: str) -> DataFrame:
    """As :func:`rolling`, with a window of each entry's own: running sums of whole cents, one looked up at the window's start."""
    by = Window.partitionBy("entry").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    run = days.withColumn("__cents", F.coalesce(F.sum("cents").over(by), F.lit(0))).withColumn("__n", F.coalesce(F.sum("n").over(by), F.lit(0)))
    run = run.withColumn("earliest", F.min(F.when(F.col("n") > 0, F.col("date"))).over(by))
    before = run.select("entry", F.date_add("date", F.col(window) + 1).alias("date"), F.col("__cents").alias("__cents0"), F.col("__n").alias("__n0"))
    joined = run.join(before, ["entry", "date"], "left")
    total, count = F.col("__cents") - F.coalesce("__cents0", F.lit(0)), F.col("__n") - F.coalesce("__n0", F.lit(0))
    return joined.select(*days.columns, total.alias("total"), count.alias("count"), "earliest")


def day_counts(txns: DataFrame) -> DataFrame:
    """``(entry, date, cents, n)``: how often an entry has an amount on a day; all rates follow from it."""
    return txns.groupBy("entry", "date", "cents").agg(F.count("*").alias("n"))


def daily_of(counts: DataFrame) -> DataFrame:
    """As :func:`daily`, from counts."""
    return counts.groupBy("entry", "date").agg(F.sum(F.col("cents") * F.col("n")).alias("cents"), F.sum("n").alias("n"))


def usual_of(counts: DataFrame) -> DataFrame:
    """As :func:`usual_amounts`, from counts."""
    day = F.when(F.col("n") > 0, _day(F.col("date")))
    found = expanding_medians(counts.select("entry", day.alias("day"), F.abs("cents").alias("amount"), "n").filter("day is not null"), "entry", "day", "amount", "n")
    return found.select("entry", F.date_from_unix_date("day").alias("date"), "median", "max")


def usual_amounts(txns: DataFrame) -> DataFrame:
    """``(entry, date, median, max)`` of the absolute amounts up to each day with transactions, null before the first amount; those without an amount count nowhere."""
    return usual_of(txns.groupBy("entry", "date", F.abs("cents").alias("cents")).agg(F.count("*").alias("n")))


def rates_of(counts: DataFrame, entries: DataFrame, window: int, override: str | None = None, begin: str | None = None) -> DataFrame:
    """Rates from :func:`day_counts` and entries with ``as_of``; see :func:`entry_rates`.

    ``begin`` names a column of the entries with the first day that is asked for. Earlier
    counts then need their own days only within the window before it; older ones may stand
    together on any earlier day, and the entries hold ``first_date``, their first day with
    a transaction.
    """
    last = F.least(F.coalesce("end_date", "as_of"), F.col("as_of"))
    first = F.greatest("start_date", F.date_sub(begin, window)) if begin else F.col("start_date")
    lives = entries.withColumn("__first", first).withColumn("__last", last).filter("__first <= __last")
    days = lives.withColumn("date", F.explode(F.sequence("__first", "__last")))
    usual = usual_of(counts.filter("cents is not null"))
    if begin:
        usual = usual.join(lives.select("entry", "__first"), "entry").withColumn("__at", F.greatest("date", "__first"))
        usual = usual.groupBy("entry", F.col("__at").alias("date")).agg(F.max_by("median", "date").alias("median"), F.max_by("max", "date").alias("max"))
    days = days.join(daily_of(counts), ["entry", "date"], "left").join(usual, ["entry", "date"], "left")
    upto = Window.partitionBy("entry").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    amount = F.when(F.col("rate_method") == "max", F.col("max")).otherwise(F.col("median"))
    days = rolling(days.withColumn("usual", F.last(amount, ignorenulls=True).over(upto)), window)
    if begin:
        days = days.withColumn("earliest", F.when(F.col("first_date") <= F.col("date"), F.col("first_date"))).filter(F.col("date") >= F.col(begin))
    rate = F.coalesce(F.col("usual") / window * sign_of(F.col("direction")), F.lit(0.0))
    if override:
        rate = F.coalesce(F.col(override).cast("double"), rate)
    days = days.withColumn("days", window_days(F.col("date"), F.col("earliest"), window))
    days = days.withColumn("actual", F.round(actual_rate(F.col("total"), F.col("days")), 4)).withColumn("projected", F.round(rate, 4))
    days = days.withColumn("drift", F.round(drift(F.col("actual"), F.col("projected")), 4))
    return days.select("entry", "entity", "label", "direction", "period_days", "status", "date", "count", "days", "total", "actual", "projected", "drift")


def entry_rates(txns: DataFrame, entries: DataFrame, window: int, override: str | None = None) -> DataFrame:
    """``(entry, label, direction, period_days, date, count, days, total, actual, projected, drift)`` per entry and day.

    The projected rate is the entry's override if it has one; else the usual amount (by
    the entry's ``rate_method``, over all transactions so far) spread over the window;
    0 before the first transaction. Rates are rounded to four places as they are stored.
    Transactions before an entry's start are not its own. They are read once: counts by day and
    amount are written, and all else reads these.
    """
    counts = cut_lineage(day_counts(txns))
    lives = cut_lineage(entries.crossJoin(F.broadcast(as_of(counts))))
    own = counts.join(lives.select("entry", "start_date"), "entry").filter("date >= start_date").drop("start_date")
    return rates_of(own, lives, window, override)


def label_direction() -> Column:
    """Of a label's entries: mixed if all are, income if any is, else spend."""
    return F.when(F.every(F.col("direction") == "mixed"), "mixed").when(F.some(F.col("direction") == "income"), "income").otherwise("spend")


def label_rates(rates: DataFrame) -> DataFrame:
    """Rates of each entity's labels per day, over all entries of the label."""
    return rates.filter("label is not null").groupBy("entity", "label", "date").agg(
        F.round(F.sum("actual"), 4).alias("actual"), F.round(F.sum("projected"), 4).alias("projected"), F.sum("count").alias("count"),
        F.max("period_days").alias("period_days"), label_direction().alias("direction"), F.count("*").alias("entries"),
    )


_MOMENTS = ("k", "x", "y", "xx", "xy", "yy")


def trends(rates: DataFrame, key: str) -> DataFrame:
    """Slope and r squared of the actual rate over the last three periods of each row, today included.

    Running sums of days, rates and their products up to a day, less those before its window
    begins, give the moments of any window; rates have four places, so all sums are whole
    numbers and nothing is lost by subtraction. The plan does not depend on how many periods
    there are. Fewer than two points have no trend.
    """
    whole = "decimal(38,0)"
    day, rate = _day(F.col("date")).cast("decimal(9,0)"), F.round(F.col("actual") * 10000).cast("decimal(18,0)")
    there = rates.withColumn("__x", F.when(rate.isNotNull(), day)).withColumn("__y", rate)
    upto = Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    parts = {"k": F.count("__y"), "x": F.sum("__x"), "y": F.sum("__y"), "xx": F.sum(F.expr("__x * __x")), "xy": F.sum(F.expr("__x * __y")), "yy": F.sum(F.expr("__y * __y"))}
    sums = F.struct(*(F.coalesce(v.over(upto).cast(whole), F.lit(0).cast(whole)).alias(k) for k, v in parts.items()))
    run = there.withColumn("__upto", sums).drop("__x", "__y")
    # each row is there twice: on its day, and as a question on the day before its window begins
    days = F.array(F.struct(F.col("date").alias("day"), F.lit(False).alias("asks")), F.struct(F.date_sub("date", F.col("period_days") * 3 + 1).alias("day"), F.lit(True).alias("asks")))
    twice = run.withColumn("__d", F.explode(days))
    by = Window.partitionBy(key).orderBy("__d.day", "__d.asks").rowsBetween(Window.unboundedPreceding, 0)
    rows = twice.withColumn("__before", F.last(F.when(~F.col("__d.asks"), F.col("__upto")), ignorenulls=True).over(by)).filter("__d.asks")
    for m in _MOMENTS:
        rows = rows.withColumn(f"__{m}", F.col(f"__upto.{m}") - F.coalesce(F.col(f"__before.{m}"), F.lit(0).cast(whole)))
    k = F.col("__k").cast("double")
    spread = {m: F.expr(e).cast("double") / k / k for m, e in (("x", "__k * __xx - __x * __x"), ("xy", "__k * __xy - __x * __y"), ("y", "__k * __yy - __y * __y"))}
    enough = (F.col("__k") >= 2) & (spread["x"] > 0)
    slope = F.when(enough, spread["xy"] / 10000 / spread["x"]).otherwise(0.0)
    fit = F.when(~enough, F.lit(0.0)).when(spread["y"] == 0, 1.0).otherwise(spread["xy"] / spread["x"] * spread["xy"] / spread["y"])
    return rows.select(*rates.columns, F.round(slope, 6).alias("slope"), F.round(fit, 3).alias("r_squared"))


def regression(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, slope, r_squared)`` of a value over days; fewer than two points have no trend."""
    day, enough = _day(F.col("date")), F.count("*") >= 2
    slope, fit = F.when(enough, F.regr_slope(value, day)).otherwise(0.0), F.when(enough, F.regr_r2(value, day)).otherwise(0.0)
    return rows.groupBy(key).agg(F.round(slope, 6).alias("slope"), F.round(fit, 3).alias("r_squared"))


def with_prior(rates: DataFrame, key: str = "entry") -> DataFrame:
    """Rates with the actual rate of the snapshot before, ``prior``."""
    return rates.withColumn("prior", F.lag("actual").over(Window.partitionBy(key).orderBy("date")))


def viewport(shown: DataFrame, more: DataFrame, size: int, offset: int, key: str = "entry") -> DataFrame:
    """The ``size`` latest days of each key that come after the ``offset`` latest, of what is shown and what is loaded more; a day that both have counts once, as shown."""
    both = shown.withColumn("__o", F.lit(0)).unionByName(more.withColumn("__o", F.lit(1)))  # 0 is what is shown
    first = F.row_number().over(Window.partitionBy(key, "date").orderBy("__o"))
    once = both.withColumn("__k", first).filter("__k = 1").drop("__k", "__o")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("date").desc()))
    return once.withColumn("__k", place).filter(F.col("__k").between(offset + 1, offset + size)).drop("__k")


def synced_rates(entries: DataFrame, latest: DataFrame, rate: str) -> DataFrame:
    """Entries whose live system ones have taken the projected rate of their latest snapshot, in the column ``rate``."""
    system = F.col("source") == "system"
    joined = entries.join(latest.select("entry", F.col("projected").alias("__p")), "entry", "left")
    return joined.withColumn(rate, F.when(system & (F.col("status") == "live"), F.coalesce("__p", rate)).otherwise(F.col(rate))).drop("__p")


SNAPSHOT = ["node", "node_type", "date", "actual", "projected", "drift", "slope", "r_squared", "transactions", "window_days", "total"]


def entry_snapshots(trended: DataFrame) -> DataFrame:
    """Snapshot rows of entries with their trends."""
    return trended.withColumns({"node": F.col("entry"), "node_type": F.lit("entry"), "transactions": F.col("count"), "window_days": F.col("days")}).select(SNAPSHOT)


def label_node() -> Column:
    return F.concat_ws(":", F.col("entity").cast("string"), "label")


def label_snapshots(trended: DataFrame) -> DataFrame:
    """Snapshot rows of labels with their trends: the window is the period, the count that of entries."""
    drifted = {"node_type": F.lit("label"), "drift": F.round(F.col("actual") - F.col("projected"), 4), "transactions": F.col("entries"), "window_days": F.col("period_days"), "total": F.lit(0).cast("bigint")}
    return trended.withColumns(drifted).select(SNAPSHOT)


def snapshots(txns: DataFrame, entries: DataFrame, window: int) -> DataFrame:
    """Snapshot rows of all entries and labels, every day of their life; rates are written once, both read them."""
    rates = cut_lineage(entry_rates(txns, entries, window))
    return entry_snapshots(trends(rates, "entry")).unionByName(label_snapshots(trends(label_rates(rates).withColumn("node", label_node()), "node")))


def merge_snapshots(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("node", "date")) -> DataFrame:
    """Upsert: new rows over old ones of the same key."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def dirty_days(entries: DataFrame, txns: DataFrame, stored: DataFrame, flux_days: int, bypass: bool = False) -> DataFrame:
    """``(entry, date)`` that must be computed anew.

    A day of an entry's life is dirty when it is in flux, not before the entry's last
    stored day (its start, if none is stored), or not stored; with ``bypass`` always.
    """
    days = grid(entries.crossJoin(F.broadcast(as_of(txns))), F.col("as_of"))
    seen = stored.groupBy("entry").agg(F.max("date").alias("last_stored"))
    have = stored.select("entry", "date").distinct().withColumn("stored", F.lit(True))
    rows = days.join(seen, "entry", "left").join(have, ["entry", "date"], "left")
    flux = F.col("date") >= F.date_sub("as_of", flux_days)
    dirty = flux | (F.col("date") >= F.coalesce("last_stored", "start_date")) | F.col("stored").isNull() | F.lit(bypass)
    return rows.filter(dirty).select("entry", "date")
