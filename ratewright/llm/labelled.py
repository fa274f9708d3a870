"""Bounded samples of labelled rows, the only data that models are fitted on here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_crc(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def known_labels(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, label)`` of all rows with an id and a label of 0 or 1; the ids are in ``id_col``, or in ``doc_id`` where that is missing.

    Of repeated ids the least label counts.
    """
    key = id_col if id_col in labels.columns else "doc_id"
    known = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    return known.filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most ``rows`` labelled rows of each class as ``(doc_id, text, label)``, the same ones in every run.

    Rows are taken in the order of a hash of their id. Ids are chosen on the narrow
    label table first, so only the chosen texts are read out of the documents.
    """
    known = known_labels(labels, label, id_col)
    order = F.xxhash64("doc_id")
    chosen = known.filter("label = 0").orderBy(order, "doc_id").limit(rows).unionByName(known.filter("label = 1").orderBy(order, "doc_id").limit(rows))
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")
