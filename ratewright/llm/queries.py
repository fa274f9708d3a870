"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, license_scan, line_crf, packing, pairwise_quality, pii, token_attribution, toxicity, url_reputation
from .importance import ImportanceResampler
from .labelled import text_crc
from .ngram_join import NgramJaccardJoin
from .vector_clusters import VectorClusters


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels")
    return url_reputation.judge(pages, url_reputation.outcomes_by_link(pages, labels))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    join = NgramJaccardJoin(n=3, threshold=0.9)
    return join.components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def span_list(spans: str) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(_table(spark, sf_dir, "documents"))
    counts = [F.size(pii.of_kind("base", kind)).cast("long").alias(f"n_{kind}") for kind in pii.BASE_KINDS]
    every = F.size("spans").cast("long").alias("n_spans")
    return found.select("doc_id", *counts, F.sha2(span_list("base"), 256).alias("base_sha256"), span_list("spans").alias("spans"), every)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return token_attribution.section_tokens(documents, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _judged(scores: DataFrame, held_out: Column, *more: str) -> DataFrame:
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *more)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = text_crc("doc_id", 5) == 0
    labels = _table(spark, sf_dir, "labels").filter(~held_out)
    return _judged(toxicity.toxicity(_table(spark, sf_dir, "documents"), labels), held_out, "passages")


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = text_crc("doc_id", 3) == 1
    labels = _table(spark, sf_dir, "labels").filter(~held_out)
    return _judged(pairwise_quality.quality_scores(_table(spark, sf_dir, "documents"), labels), held_out)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ImportanceResampler().draw(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(text_crc("doc_id", 5) == 0, F.lit(False))
    model = language_id.fit(documents.filter(text_crc("doc_id", 5) != 0))
    return language_id.identify(documents, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VectorClusters().clusters(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_ngram_jaccard_join, op3_packing, op4_pii, op5_token_counts,
        op6_quality_rules, op7_decontamination, op8_toxicity, op9_license_scans, op10_quality_classifier,
        op11_importance_resampling, op12_language_id, op13_centroid_clustering,
    )
}

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _level_sql(name: str, key: str, above: str, prior: str) -> str:
    """CTEs of one level of the beta priors: groups, their spread, and means shrunk to the level above."""
    low, high = url_reputation.STRENGTH
    return f"""
{name}_seen as (
  select c.{key}, any_value(p.mean) as prior, sum(c.good) as good, sum(c.n) as n
  from (select {key}, {above}, sum(good) as good, sum(n) as n from counts group by all) c join {prior} p using ({above}) group by c.{key}),
{name}_spread as (
  select sum(n) as pages, sum(n * n) as squares, count(*) as groups, sum(n * (good / n - prior) * (good / n - prior)) as between_,
    sum(n * prior * (1 - prior)) as within_ from {name}_seen),
{name}_strength as (
  select case when pages > 0 and (between_ - within_ * groups / pages) / nullif(pages - squares / pages, 0) > 0
    then greatest({low}, least({high}, within_ / pages / ((between_ - within_ * groups / pages) / nullif(pages - squares / pages, 0)) - 1))
    else {high} end as strength from {name}_spread),
{name} as (select {key}, n, strength, (good + strength * prior) / (n + strength) as mean from {name}_seen, {name}_strength)"""


OP1_SQL = rf"""
with urls as (
  select page_id, coalesce({_FOLD.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
linked as (
  select page_id, try_cast(nullif(regexp_extract(path, '^/[a-z]+/([0-9]{{1,18}})(\.html)?/?$', 1), '') as bigint) as doc_id from urls),
outcomes as (
  select page_id, max(case when quality = 1 and toxic = 0 then 1 else 0 end) as good from linked join labels using (doc_id) group by page_id),
counts as (
  select host, '' as everything, list_extract(string_split(host, '.'), -1) as suffix,
    array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') as domain, sum(good) as good, count(*) as n
  from urls join outcomes using (page_id) where host <> '' group by host),
total as (select '' as everything, (sum(good) + 1) / (sum(n) + 2) as mean from counts having sum(n) > 0),
{_level_sql("suffixes", "suffix", "everything", "total")},
{_level_sql("domains", "domain", "suffix", "suffixes")},
{_level_sql("hosts", "host", "domain", "domains")},
known as (select host, n, mean, mean + {url_reputation.Z} * sqrt(mean * (1 - mean) / (n + strength + 1)) as upper_ from hosts),
ruled as (
  select *, case
    when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from urls)
select page_id, host, path, rule,
  case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
    when upper_ < {url_reputation.LEAST_GOOD} then 'block' else 'allow' end as verdict,
  cast(coalesce(n, 0) as bigint) as n, round(mean, 6) as good_mean, round(upper_, 6) as good_upper
from ruled left join known using (host)
"""

OP2_SQL = rf"""
with recursive texts as (
  select doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from texts),
distinct_sets as (select min(doc_id) as rep, s, len(s) as n from (select doc_id, list_sort(s) as s from sets) where len(s) > 0 group by s),
items as (select rep, n, unnest(s) as item from distinct_sets),
pairs as (
  select a.rep as u, b.rep as v from items a join items b on a.item = b.item and a.rep < b.rep
  group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
edges as (select u, v from pairs union all select v, u from pairs),
reach as (select rep as x, rep as y from distinct_sets union select r.x, e.v from reach r join edges e on e.u = r.y),
classes as (select x as rep, min(y) as component_id from reach group by x)
select doc_id, cast(len(sets.s) as bigint) as n_shingles, coalesce(component_id, doc_id) as component_id
from sets left join distinct_sets on list_sort(sets.s) = distinct_sets.s left join classes using (rep)
"""

#: CRC32 of the bytes in the list ``b``; the table of a byte's eight steps is made from the polynomial.
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: xor(c >> 8, steps[xor(c & 255, x) + 1])), 4294967295::bigint)"
_STEP = "lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end"

OP11_SQL = rf"""
with texts as (
  select 0 as side, doc_id, text from documents union all select 1, null, text from benchmark),
numbered as (select row_number() over () as row, * from texts),
cut as (
  select row, side, doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from numbered),
runs as (
  select row, side, unnest(list_concat(w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as f from cut),
crc_steps as (select list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), {_STEP})) as steps),
bytes as (select f, list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::bigint) as b from (select distinct f from runs)),
buckets as (select f, {_CRC} % 10000 as bucket from bytes, crc_steps),
hit as (select row, side, bucket from runs join buckets using (f)),
counted as (select bucket, count(*) filter (side = 0) as s, count(*) filter (side = 1) as t from hit group by bucket),
sums as (select sum(s)::double as all_s, sum(t)::double as all_t from counted),
gains as (
  select bucket, floor(1000 * ln(((t + 1)::double * (all_s + 10000)) / ((s + 1)::double * (all_t + 10000))))::bigint as gain from counted, sums),
weights as (select row, count(*) as n_features, sum(gain)::bigint as weight from hit join gains using (bucket) where side = 0 group by row),
scored as (
  select row, doc_id, len(w) >= 20 as fit, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    ('0x' || substr(sha256('42:' || doc_id), 1, 8))::bigint::double as h from cut left join weights using (row) where side = 0),
noisy as (select *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::bigint as score from scored),
placed as (select *, row_number() over (partition by fit order by score desc, doc_id) as place, count(*) filter (fit) over () as n from noisy)
select doc_id, n_features, weight, score, case when fit and place <= 5 * n // 100 then place end as rank from placed
"""


def _clusters_sql() -> str:
    """All rounds of the centroid clustering, each as the assignment and the means of it."""
    distance = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::bigint"
    parts = []
    for r in range(6):
        parts.append(f"near{r} as materialized (select vec_id, v.x, arg_min(c.cluster, (d, c.cluster)) as cluster, min(d) as distance from (select v.row, v.vec_id, v.x, c.cluster, {distance} as d from kept v, c{r} c) v join c{r} c using (cluster) group by v.row, vec_id, v.x)")
        if r < 5:
            parts.append(f"s{r} as (select cluster, i, sum(x[i]) as total, count(*) as n from near{r}, range(1, 65) t(i) group by cluster, i)")
            parts.append(f"m{r} as (select cluster, list((total - ((total % n) + n) % n) // n order by i)::bigint[] as x from s{r} group by cluster)")
            parts.append(f"c{r + 1} as materialized (select c{r}.cluster, coalesce(m{r}.x, c{r}.x) as x from c{r} left join m{r} using (cluster))")
    return ", ".join(parts)


OP13_SQL = f"""
with sound as (
  select vec_id, embedding from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda v: v is not null and isfinite(v))) = 64),
kept as materialized (select row_number() over () as row, vec_id, list_transform(embedding, lambda v: floor(v::double * 256)::bigint) as x from sound),
c0 as materialized (select row_number() over (order by sha256('2:' || vec_id)) - 1 as cluster, x from kept qualify cluster < 40),
{_clusters_sql()},
spread as (select cluster, sum(distance)::bigint as cluster_inertia from near5 group by cluster)
select vec_id, near5.cluster::integer as cluster, distance, cluster_inertia, (select sum(distance) from near5)::bigint as inertia, sha256(array_to_string(c5.x, ',')) as centroid_sha256
from near5 join spread using (cluster) join c5 using (cluster)
"""

ORACLE_SQL = {"op1_url_filters": OP1_SQL, "op2_ngram_jaccard_join": OP2_SQL, "op11_importance_resampling": OP11_SQL, "op13_centroid_clustering": OP13_SQL}
