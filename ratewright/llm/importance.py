"""Importance resampling towards a target text, by hashed word runs.

One scan keeps, for each text, a ring of running CRC states: one for each of the last
``n`` starts. A word extends every state by a space and itself and begins a new one, so
each run of 1 to n words costs one step over its last word, however long it is. The scan
writes each text's buckets; counts, gains and weights are computed from these. Texts are
then drawn without replacement by Gumbel noise on their weights.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .storage import discard, materialize

#: Bytes of a text that are cut into words at a time, and texts taken from a batch at a time.
PIECE, TEXTS = 1 << 20, 256
#: A-Z to a-z; all of ASCII that is neither letter nor digit to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


def words(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, a piece of it at a time; no piece ends within a word."""
    at = 0
    rest = b""
    while at < len(text):
        piece = rest + text[at : at + PIECE].translate(_FOLD)
        at += PIECE
        end = len(piece) if at >= len(text) else piece.rfind(b" ") + 1
        rest = piece[end:]
        yield piece[:end].split()


def ring_buckets(text: bytes, n: int, buckets: int) -> tuple[int, array]:
    """How many words a text has, and the bucket of every run of 1 to ``n`` of them."""
    out, count, crc = array("i"), 0, zlib.crc32
    ring: list[int] = []  # states of the last starts, newest first
    for piece in words(text):
        count += len(piece)
        for word in piece:
            spaced = b" " + word
            states = [crc(word), *[crc(spaced, state) for state in ring]]
            out.extend([state % buckets for state in states])
            ring = states[: n - 1]
    return count, out


def _scan(n: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, TEXTS):
                texts = batch.column(1).slice(first, TEXTS).cast(pa.binary()).to_pylist()
                flat, sizes, counts = array("i"), [0], []
                for text in texts:
                    count, own = ring_buckets(text or b"", n, buckets)
                    flat.extend(own)
                    counts.append(count)
                    sizes.append(len(flat))
                lists = K.list_array(pa.array(np.frombuffer(flat, np.int32)), np.array(sizes))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, TEXTS), pa.array(counts, pa.int64()), lists], names=["doc_id", "n_words", "buckets"])

    return run


def _weigh(gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy()
            total = np.concatenate([[0], np.cumsum(gains[lists.values.to_numpy()[offsets[0] : offsets[-1]]])])
            offsets = offsets - offsets[0]
            weight, size = total[offsets[1:]] - total[offsets[:-1]], np.diff(offsets).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def floor_long(x: Column) -> Column:
    return F.floor(x).cast("long")


@dataclass(frozen=True)
class ImportanceResampler:
    """Draws ``percent`` in a hundred of the texts with at least ``least_words`` words, those likest a target text being likelier.

    ``buckets`` bounds the model: it is a gain per bucket, and that is all that reaches the driver.
    """

    n: int = 3
    buckets: int = 10_000
    percent: int = 5
    least_words: int = 20
    seed: int = 42

    def features(self, texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``(doc_id, n_words, buckets)`` of every text, a null text having none."""
        rows = texts.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        return rows.mapInArrow(K.released(_scan(self.n, self.buckets)), "doc_id long, n_words long, buckets array<int>")

    def counts(self, features: DataFrame) -> DataFrame:
        """``(bucket, n)`` over all texts; each task adds up its own before the shuffle."""
        return features.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))

    def gains(self, source: DataFrame, target: DataFrame) -> DataFrame:
        """``(bucket, gain)`` of every bucket: a thousand times the log of its smoothed share in the target over that in the source."""
        every = source.sparkSession.range(self.buckets).select(F.col("id").cast("int").alias("bucket"))

        def counted(counts: DataFrame, name: str) -> DataFrame:
            return every.join(counts.withColumnRenamed("n", name), "bucket", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("double"))

        both = counted(source, "s").join(counted(target, "t"), "bucket")
        totals = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row
        share = F.expr(f"((t + 1) * (all_s + {self.buckets})) / ((s + 1) * (all_t + {self.buckets}))")
        return both.crossJoin(F.broadcast(totals)).select("bucket", floor_long(1000 * F.ln(share)).alias("gain"))

    def score(self, doc_id: Column, weight: Column) -> Column:
        """The weight with Gumbel noise that depends on the id and the seed only; a row without an id has the noise of an empty one."""
        digest = F.sha2(F.concat(F.lit(f"{self.seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
        h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
        return weight + floor_long(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))

    def weighted(self, documents: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``(doc_id, n_words, n_features, weight, score)`` of every document, as a written table."""
        features = materialize(self.features(documents, id_col, text_col), "features")
        texts = target.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        gains = np.zeros(self.buckets, np.int64)
        for row in self.gains(self.counts(features), self.counts(self.features(texts))).collect():  # a row per bucket
            gains[row.bucket] = row.gain
        weighed = features.mapInArrow(K.released(_weigh(gains)), "doc_id long, n_words long, n_features long, weight long")
        out = materialize(weighed.withColumn("score", self.score(F.col("doc_id"), F.col("weight"))), "weights")
        discard(features)
        return out

    def draw(self, documents: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``(doc_id, n_features, weight, score, rank)`` of every document; rank is 1, 2, 3... for those drawn, null for the rest.

        Ranks are global without a global sort in one task: rows go to ranges of (score, doc_id),
        each range counts its rows, and a range's ranks begin after the counts before it.
        A null or empty text has no features and weight 0. Rows with equal ids are weighed and
        drawn each; one without an id comes after all others of its score. An empty table gives
        no rows, an empty target makes rare words likelier; other columns are ignored.
        """
        rows = self.weighted(documents, target, id_col, text_col)
        fit = F.col("n_words") >= self.least_words
        order = [F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        slots = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranges = rows.withColumn("fit", fit).repartitionByRange(slots, *order).withColumn("part", F.spark_partition_id())
        ranges = materialize(ranges, "ranges")
        discard(rows)
        sizes = ranges.groupBy("part").agg(F.count_if("fit").alias("n"))
        earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        before = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))  # one row per range
        wanted = ranges.agg(F.expr(f"count_if(fit) * {self.percent} div 100").alias("wanted"))  # one row
        placed = ranges.join(F.broadcast(before), "part").crossJoin(F.broadcast(wanted))
        place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before")
        rank = F.when(F.col("fit") & (F.col("place") <= F.col("wanted")), F.col("place"))
        return placed.withColumn("place", place).select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"))
