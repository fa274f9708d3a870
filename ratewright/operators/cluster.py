"""Recurring patterns among unmatched transactions: clusters, scores, anchors, proposed entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewright.functions.dates import normalize_dom
from ratewright.functions.money import grouped_median
from ratewright.functions.text import canonical_merchant, title_case

#: Least timing fit of a standing entry, and least fitness of a proposal.
STANDING, PROPOSED = 0.45, 0.30


def cluster_keys(merchants: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, canonical, cluster)``: each canonical name with the word that it shares with others of the same ``by``.

    A word of two or more names is a signal. Among a name's signals the most frequent
    one wins; then one without a hyphen, then the longer, then the first by alphabet.
    A name without a signal is a cluster of its own.
    """
    names = merchants.select(*by, canonical_merchant(F.col("merchant")).alias("canonical")).distinct()
    words = names.select(*by, "canonical", F.explode(F.split(F.lower("canonical"), r"\s+")).alias("word"))
    often = words.groupBy(*by, "word").agg(F.count("*").alias("df")).filter("df >= 2")
    rank = F.struct("df", (~F.col("word").contains("-")).cast("int").alias("plain"), F.length("word").alias("size"))
    ranked = words.join(often, [*by, "word"]).withColumn("rank", rank)
    first = Window.partitionBy(*by, "canonical").orderBy(F.col("rank").desc(), "word")
    best = ranked.withColumn("__k", F.row_number().over(first)).filter("__k = 1").select(*by, "canonical", title_case(F.col("word")).alias("signal"))
    return names.join(best, [*by, "canonical"], "left").select(*by, "canonical", F.coalesce("signal", "canonical").alias("cluster"))


def clustered(txns: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Transactions with their ``canonical`` name and ``cluster``."""
    named = txns.withColumn("canonical", canonical_merchant(F.col("merchant")))
    return named.join(cluster_keys(txns.select(*by, "merchant").distinct(), by), [*by, "canonical"])


def gaps(txns: DataFrame, key: str) -> DataFrame:
    """Transactions with the days since the one before in their group.

    Only days are ordered within a group; all but the first transaction of a day have no gap to the one before.
    """
    by = Window.partitionBy(key).orderBy("date")
    days = txns.groupBy(key, "date").agg(F.min("id").alias("__first")).withColumn("__gap", F.date_diff("date", F.lag("date").over(by)))
    days = days.select(F.col(key).alias("__key"), F.col("date").alias("__date"), "__first", "__gap")
    rows = txns.join(days, F.col(key).eqNullSafe(F.col("__key")) & F.col("date").eqNullSafe(F.col("__date")), "left")
    return rows.select(*txns.columns, F.when(F.col("id") == F.col("__first"), F.col("__gap")).otherwise(F.date_diff("date", "date")).alias("gap"))


def _timing_fit(n: Column, spread: Column) -> Column:
    return F.when(n < 2, F.lit(0.0)).when(spread <= 5, F.lit(1.0)).otherwise(F.lit(5.0) / F.nullif(spread, F.lit(0.0)))


def score(txns: DataFrame, key: str) -> DataFrame:
    """``(key, n, median, mean_gap, timing_fit, amount_fit, entry_type, fitness)`` of every group."""
    spaced = gaps(txns, key)
    median = grouped_median(txns, [key], "cents", "median")
    stats = spaced.groupBy(key).agg(F.count("*").alias("n"), F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("spread"), F.min("cents").alias("low"), F.max("cents").alias("high"))
    rows = stats.join(median, key)
    away = F.greatest(F.abs(F.col("low") - F.col("median")), F.abs(F.col("high") - F.col("median"))) / F.nullif(F.abs("median"), F.lit(0))
    rows = rows.withColumn("timing_fit", _timing_fit(F.col("n"), F.col("spread")))
    rows = rows.withColumn("amount_fit", F.when((F.col("n") == 1) | (F.col("median") == 0), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - F.least(away, F.lit(1.0)))))
    standing = (F.col("n") >= 2) & (F.col("timing_fit") >= STANDING)
    fitness = F.when(standing, F.expr("0.3D + 0.55D * timing_fit + 0.15D * amount_fit")).otherwise(F.expr("0.6D + 0.2D * timing_fit + 0.2D * amount_fit"))
    return rows.select(key, "n", "median", "mean_gap", "timing_fit", "amount_fit", F.when(standing, "standing").otherwise("variable").alias("entry_type"), fitness.alias("fitness"), "low", "high")


def mode_of(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, mode)``: the most frequent value, the smallest on ties."""
    counted = rows.groupBy(key, value).agg(F.count("*").alias("__n"))
    return counted.groupBy(key).agg(F.max_by(value, F.struct(F.col("__n"), -F.col(value))).alias("mode"))


def anchors(txns: DataFrame, key: str) -> DataFrame:
    """``(key, anchor)``: weekly, twice a month, monthly, or every so many days; null for a single date.

    Only distinct days of month and weekdays are gathered, 59 and 7 at most.
    """
    days = gaps(txns, key).withColumn("dom", normalize_dom(F.col("date")))
    facts = days.groupBy(key).agg(
        F.avg("gap").alias("mean"), F.count("*").alias("n"), F.collect_set(F.weekday("date")).alias("dows"), F.array_sort(F.collect_set("dom")).alias("doms")
    )
    rows = facts.join(mode_of(days, key, "dom"), key)
    mean, mode = F.col("mean"), F.col("mode")
    monthly = F.forall("doms", lambda d: F.abs(d - mode) <= 5)
    # two days a month, the one counted from the start first
    pair = F.array_join(F.concat(F.filter("doms", lambda d: d > 0), F.filter("doms", lambda d: d < 0)).cast("array<string>"), ",")
    anchor = (
        F.when((F.col("n") < 2) | mean.isNull(), F.lit(None).cast("string"))
        .when(mean.between(5, 9) & (F.size("dows") == 1), F.concat(F.lit("dow:"), F.get("dows", 0).cast("string")))
        .when(mean.between(13, 17) & (F.size("doms") == 2), F.concat(F.lit("dom:"), pair))
        .when(mean.between(20, 45) & monthly, F.concat(F.lit("dom:"), mode.cast("string")))
        .otherwise(F.concat(F.lit("interval:"), F.round(mean).cast("int").cast("string")))
    )
    return rows.select(key, anchor.alias("anchor"))


def conditions_json(cluster: Column, all_start: Column, entry_type: Column, anchor: Column, low: Column, high: Column) -> Column:
    """The condition tree of a proposal: its payee, and for a standing one its anchor and range of amounts."""

    def leaf(kind: Column | str, **values: Column) -> Column:
        fields = [(F.lit(kind) if isinstance(kind, str) else kind).alias("type"), *(v.alias(k) for k, v in values.items())]
        return F.to_json(F.struct(*fields))

    payee = leaf(F.when(all_start, "payee_starts_with").otherwise("payee_contains"), value=cluster)
    standing = entry_type == "standing"
    timing = F.when(standing & anchor.isNotNull(), leaf("recurrence_anchor", recurrence_anchor=anchor, tolerance_days=F.lit(5)))
    amount = F.when(standing, leaf("amount_range", min_cents=low, max_cents=high))
    return F.concat(F.lit('{"op":"AND","children":['), F.concat_ws(",", payee, timing, amount), F.lit("]}"))


def propose(txns: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Entries proposed from unmatched transactions: one row per ``by`` and cluster that scores at least :data:`PROPOSED`."""
    rows = clustered(txns, by).withColumn("key", F.struct(*by, "cluster"))
    starts = rows.groupBy("key").agg(
        F.every(F.lower("merchant").startswith(F.lower("cluster"))).alias("all_start"), F.min("date").alias("start_date"), F.max("date").alias("last_date")
    )
    samples = rows.select("key", "merchant").distinct()
    first = Window.partitionBy("key").orderBy("merchant")
    samples = samples.withColumn("__k", F.row_number().over(first)).filter("__k <= 5").groupBy("key").agg(F.array_sort(F.collect_list("merchant")).alias("sample_merchants"))
    found = score(rows, "key").join(anchors(rows, "key"), "key").join(starts, "key").join(samples, "key").filter(F.col("fitness") >= PROPOSED)
    period = F.coalesce(F.greatest(F.round("mean_gap").cast("int"), F.lit(1)), F.lit(30))
    return found.select(
        "key.*",
        F.when(F.col("median") < 0, "spend").otherwise("income").alias("direction"),
        "entry_type",
        period.alias("period_days"),
        (F.col("median") / period).alias("projected_rate_per_day"),
        conditions_json(F.col("key.cluster"), F.col("all_start"), F.col("entry_type"), F.col("anchor"), F.col("low"), F.col("high")).alias("conditions"),
        "anchor", "fitness", "timing_fit", "amount_fit", "n", "start_date", "last_date", "sample_merchants",
    )


def gap_chunks(txns: DataFrame, key: str, period: Column, slack: int = 5) -> DataFrame:
    """``(key, chunk, start_date, end_date, n)``: a gap of more than the period and the slack begins a new chunk."""
    new = F.when(F.col("gap") > period + slack, 1).otherwise(0)
    days = gaps(txns, key).groupBy(key, "date").agg(F.max(new).alias("new"), F.count("*").alias("n"))
    by = Window.partitionBy(key).orderBy("date")
    cut = days.withColumn("chunk", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return cut.groupBy(key, "chunk").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.sum("n").alias("n"))
