"""Corpus preparation: five operators in a row, each over all that its predecessor kept.

Quality rules reject documents, the n-gram Jaccard join leaves one document of each
group of near copies (five words, 0.8), decontamination drops documents that hold a
benchmark item, personal data is redacted, and what is left is packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright.llm import decontaminate, line_crf, packing, pii
from ratewright.llm.ngram_join import NgramJaccardJoin
from ratewright.llm.storage import discard, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_crf.keep_content(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return NgramJaccardJoin(n=5, threshold=0.8).representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", one_of_each_group),
    ("decontamination", decontaminated),
    ("pii", redacted),
    ("packing", packed),
]

#: The stages hold trained models and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next one's input."""
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, before, sf_dir), name)
        if k:
            discard(before)
        before = docs
    return docs
