"""URL filtering: rules first, then Empirical-Bayes host reputation (DataFrame functions only).

Labelled page outcomes are counted per host. A beta prior for hosts comes from
their registered domain, its prior from the public suffix, and that one from all
pages; prior strengths are moment estimates of the spread between the groups of a
level. A host is blocked when even the upper posterior bound of its share of good
pages stays under the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

#: (host, path, verdict): a rule fits its host, all subdomains, and paths that start with its path.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Standard deviations between the posterior mean and its upper bound.
Z = 1.645
#: A host whose upper bound is less is blocked.
LEAST_GOOD = 0.6
#: Hosts whose reputations may be broadcast (some 100 bytes each); beyond it they are dealt out so many times, as one host may have many pages.
BROADCAST_HOSTS, SALTS = 1 << 18, 16
#: Prior strengths are held in this range, in pages.
STRENGTH = (1.0, 200.0)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """The longest fitting rule as a struct ``(rule, verdict)``, else null."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def domain_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def _level(counts: DataFrame, key: str, above: str, prior: DataFrame) -> DataFrame:
    """Posterior mean of each group of a level: ``(key, mean)``; groups shrink to the mean of the group above."""
    groups = counts.groupBy(key, above).agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    seen = groups.join(prior, above).withColumn("rate", F.col("good") / F.col("n"))
    spread = seen.agg(
        F.sum("n").alias("pages"),
        F.sum(F.expr("n * n")).alias("squares"),
        F.count("*").alias("groups"),
        F.sum(F.expr("n * (rate - mean) * (rate - mean)")).alias("between"),
        F.sum(F.expr("n * mean * (1 - mean)")).alias("within"),
    )
    # method of moments: the variance between groups beyond that of binomial draws
    excess = "(between - within * groups / pages) / nullif(pages - squares / pages, 0)"
    typical = "within / pages"
    strength = F.expr(f"case when pages > 0 and {excess} > 0 then greatest({STRENGTH[0]}, least({STRENGTH[1]}, {typical} / ({excess}) - 1)) else {STRENGTH[1]} end")
    strengths = spread.select(F.coalesce(strength, F.lit(STRENGTH[1])).alias("strength"))  # one row
    shrunk = seen.crossJoin(F.broadcast(strengths))
    return shrunk.select(key, "good", "n", "strength", F.col("mean").alias("prior"), F.expr("(good + strength * mean) / (n + strength)").alias("mean"))


def reputations(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``(host, n, mean, upper)``: posterior share of good pages of every host in ``outcomes(page_id, good)``.

    Counts per host and the means of each level are written tables, so each is computed once.
    """
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"))
    seen = urls.filter("host <> ''").join(outcomes.select("page_id", "good"), "page_id")
    counts = seen.groupBy("host").agg(F.sum(F.col("good").cast("long")).alias("good"), F.count("*").alias("n"))
    counts = counts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), F.lit("").alias("all"), "good", "n")
    counts = materialize(counts, "host_counts")
    total = counts.groupBy("all").agg(((F.sum("good") + 1) / (F.sum("n") + 2)).alias("mean"))
    suffixes = materialize(_level(counts, "suffix", "all", total).select("suffix", "mean"), "suffix_means")
    domains = materialize(_level(counts, "domain", "suffix", suffixes).select("domain", "mean"), "domain_means")
    hosts = _level(counts, "host", "domain", domains)
    upper = F.expr(f"mean + {Z} * sqrt(mean * (1 - mean) / (n + strength + 1))")
    return materialize(hosts.select("host", "n", "mean", upper.alias("upper")), "hosts")


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] = RULES, least_good: float = LEAST_GOOD) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` and the evidence for every row of ``pages``.

    A null url, or one without ``://``, has an empty host and path, fits no rule and is
    allowed; so is a host without outcomes. Repeated rows are judged each; an empty
    table gives no rows; other columns are ignored.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    known = reputations(pages, outcomes)
    method = F.when(F.col("upper") < least_good, F.lit("block")).otherwise(F.lit("allow"))
    if known.count() <= BROADCAST_HOSTS:
        joined = urls.join(F.broadcast(known), "host", "left")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        joined = urls.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(known.withColumn("salt", salts), ["host", "salt"], "left")
    return joined.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"), F.coalesce("n", F.lit(0)).alias("n"), F.round("mean", 6).alias("good_mean"), F.round("upper", 6).alias("good_upper"))


def outcomes_by_link(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes of pages whose url path names a labelled document: good when its quality is 1 and it is not toxic."""
    doc = F.regexp_extract(path_of(F.col("url")), r"\A/[a-z]+/([0-9]{1,18})(?:\.html)?/?\z", 1)
    linked = pages.select(F.col("page_id").cast("long").alias("page_id"), doc.alias("doc"))
    linked = linked.filter("doc <> ''").select("page_id", F.col("doc").cast("long").alias("doc_id"))
    good = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)
    known = labels.filter("doc_id is not null").dropDuplicates(["doc_id"]).select(F.col("doc_id").cast("long").alias("doc_id"), good.alias("good"))
    return linked.join(known, "doc_id").select("page_id", "good").dropDuplicates(["page_id"])
