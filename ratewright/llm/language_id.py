"""Language identification by the nearest of several centroids per language.

A text is a vector of its hashed letter n-grams, within words and with the words' edges,
weighed by log frequency and inverse document frequency and normalised. Texts of each
language are clustered by cosine, so that a language may have several centroids; a text
takes the language of the nearest one, and is rejected where it is farther away than
nearly all of the texts that the centroid was made of.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K

#: Texts of each language that its centroids are made of, at most.
SAMPLE_TEXTS = 800
#: Centroids of a language, and rounds in which they are made.
CENTROIDS, ROUNDS = 4, 8
#: Buckets that n-grams are hashed into, and their lengths.
DIMS, LENGTHS = 1 << 12, (1, 2, 3, 4)
#: Share of a centroid's own texts that lie within its radius, and slack added to that.
WITHIN, SLACK = 0.995, 0.05
#: Characters of a text that are counted at a time, and texts in one dense block.
PIECE, ROWS = 1 << 18, 256

_GAP = re.compile(r"[\W\d_]")
_MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def pieces(text: str) -> Iterator[str]:
    """A text cut after a character that is no letter, so that no word is cut and no n-gram lost."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE)
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end


def _counts(texts: list[str]) -> np.ndarray:
    """How often each text has an n-gram of each bucket, as a dense block."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(lowered), dtype=np.int32), [len(t) + 1 for t in lowered])
    row = np.concatenate([[0], row]).astype(np.int32)
    letter = _letters()[points]
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # of the characters between two words one stays, the edge of both
    kept[0] = True
    x, letter, row = np.where(letter, points, 0)[kept].astype(np.uint32), letter[kept], row[kept]
    out = np.zeros(len(texts) * DIMS, np.int64)
    for n in LENGTHS:
        size = len(x) - n + 1
        if size <= 0:
            break
        inside = letter[:size].copy() if n == 1 else np.ones(size, bool)
        for k in range(1, n - 1):
            inside &= letter[k : k + size]  # no edge but at the ends
        h = np.full(size, n, np.uint32)
        for k in range(n):
            h = (h ^ x[k : k + size]) * _MULTIPLIERS[k]
            h ^= h >> np.uint32(15)
        # an n-gram belongs to the text of its last letter
        last = np.where(letter[n - 1 :], row[n - 1 :], row[max(0, n - 2) : max(0, n - 2) + size])
        out += np.bincount((last[inside].astype(np.int64) * DIMS) + (h[inside] & np.uint32(DIMS - 1)), minlength=len(out))
    return out.reshape(len(texts), DIMS)


def counts(texts: list[str]) -> np.ndarray:
    """N-gram counts of whole texts; long ones are counted piece by piece."""
    if sum(map(len, texts)) <= 2 * PIECE:
        return _counts(texts)
    return np.concatenate([sum(_counts([p]) for p in pieces(t)) if t else _counts([t]) for t in texts])


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts, nulls as empty, in blocks of a bounded size; a longer text is one block."""
    at = 0
    while at < len(texts):
        block: list[str] = []
        size = 0
        while at + len(block) < len(texts) and len(block) < ROWS:
            text = texts[at + len(block)] or ""
            size += len(text)
            if block and size > PIECE:
                break
            block.append(text)
        yield at, block
        at += len(block)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """Normalised vectors of log frequency times inverse document frequency; all zeros for a text without letters."""
    x = np.log1p(counts(texts).astype(np.float32)) * idf
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.maximum(size, 1e-12)


def cluster(x: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of unit length by spherical k-means, and the cosine distance within which nearly all of its rows lie.

    It begins with the mean's nearest row, then each time takes the row farthest from all
    centroids so far; ties go to the earlier row.
    """
    first = int((x @ x.mean(0)).argmax())
    centers = [x[first]]
    near = x @ x[first]
    while len(centers) < min(k, len(x)):
        far = int(near.argmin())
        centers.append(x[far])
        near = np.maximum(near, x @ x[far])
    c = np.stack(centers)
    for _ in range(rounds):
        of = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (of == j).any():
                mean = x[of == j].sum(0)
                c[j] = mean / max(float(np.sqrt(mean @ mean)), 1e-12)
    cosine = x @ c.T
    of = cosine.argmax(1)
    radius = [float(np.quantile(1 - cosine[of == j, j], WITHIN)) if (of == j).any() else 0.0 for j in range(len(c))]
    return c, np.array(radius)


@dataclass
class Model:
    """Centroids of all languages; their number, and so the model, is bounded by languages * CENTROIDS * DIMS."""

    languages: list[str]
    of: np.ndarray
    centroids: np.ndarray
    radius: np.ndarray
    idf: np.ndarray

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the number of its language, the cosine to the nearest centroid, and whether that is too far."""
        cosine = vectors(texts, self.idf) @ self.centroids.T
        best = cosine.argmax(1)
        near = cosine[np.arange(len(texts)), best].astype(float)
        return self.of[best], np.clip(near, 0, 1), 1 - near > self.radius[best] + SLACK


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition: how many texts have each bucket, and, at bucket -1, how many texts there are."""
    df, n = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for _, block in _blocks(batch.column(0).to_pylist()):
            df += (counts(block) > 0).sum(0)
            n += len(block)
    found = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1).astype(np.int32)), pa.array(np.append(df[found], n))], names=["bucket", "n"])


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """Inverse document frequency of each bucket over all ``texts(text)``; DIMS numbers reach the driver."""
    rows = texts.select("text").mapInArrow(K.released(_frequencies), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    seen = {r.bucket: r.n for r in rows}
    df = np.array([seen.get(b, 0) for b in range(DIMS)], float)
    return (np.log((1 + seen.get(-1, 0)) / (1 + df)) + 1).astype(np.float32)


def _vectors(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, block in _blocks(batch.column(2).to_pylist()):
                x = vectors(block, idf)
                flat = K.list_array(pa.array(x.ravel()), np.arange(len(block) + 1) * DIMS)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(block)), batch.column(1).slice(at, len(block)), flat], names=["lang", "__h", "x"])

    return run


def sample(texts: DataFrame, rows: int, idf: np.ndarray) -> DataFrame:
    """``(lang, x)``: the vectors of at most ``rows`` texts of each language of ``texts(doc_id, text, lang)``, the same ones in every run.

    Languages are counted first. About twice as many rows as wanted pass by a hash, so the
    window that takes the first by hash never sees a whole large language; vectors, not texts,
    travel to it, so a group is bounded however long its texts are.
    """
    sizes = F.broadcast(texts.groupBy("lang").agg(F.count("*").alias("__n")))  # a row per language, as the model has
    hashed = texts.join(sizes, "lang").withColumn("__h", F.xxhash64("doc_id", "text"))
    passed = hashed.filter(F.pmod("__h", F.lit(1 << 30)) * F.col("__n") < F.lit(2 * rows << 30)).select("lang", "__h", "text")
    first = Window.partitionBy("lang").orderBy("__h", "x")
    found = passed.mapInArrow(K.released(_vectors(idf)), "lang string, __h long, x array<float>")
    return found.withColumn("__k", F.row_number().over(first)).filter(F.col("__k") <= rows).select("lang", "__k", "x")


def _centroids(key: tuple, group: pa.Table) -> pa.Table:
    ordered = group.sort_by("__k")
    c, radius = cluster(np.array(ordered["x"].combine_chunks().flatten()).reshape(-1, DIMS))
    return pa.table({"lang": pa.array([key[0].as_py()] * len(c), pa.string()), "centroid": K.list_array(pa.array(c.astype(np.float64).ravel()), np.arange(len(c) + 1) * DIMS), "radius": pa.array(radius)})


def fit(documents: DataFrame, rows: int = SAMPLE_TEXTS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Centroids from at most ``rows`` texts of each language; document frequencies from all texts with a language and a letter."""
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    texts = texts.filter("lang is not null").filter(F.col("text").rlike(r"\p{L}"))
    idf = inverse_frequencies(texts)
    found = sample(texts, rows, idf).groupBy("lang").applyInArrow(_centroids, "lang string, centroid array<double>, radius double").collect()
    found.sort(key=lambda r: (r.lang, r.centroid))
    languages = sorted({r.lang for r in found})
    number = {lang: k for k, lang in enumerate(languages)}
    stacked = np.array([r.centroid for r in found], np.float32).reshape(-1, DIMS)
    return Model(languages, np.array([number[r.lang] for r in found], np.int64), stacked, np.array([r.radius for r in found]), idf)


def _judge(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(model.languages, pa.string())
        for batch in batches:
            for at, block in _blocks(batch.column(1).to_pylist()):
                ids = batch.column(0).slice(at, len(block))
                if model.languages:
                    lang, near, far = model.judge(block)
                else:
                    lang, near, far = np.zeros(len(block), int), np.zeros(len(block)), np.ones(len(block), bool)
                known = np.array([has_letter(t) for t in block], bool) & bool(model.languages)
                found = names.take(pa.array(lang, mask=~known)).fill_null("und") if model.languages else pa.array(["und"] * len(block))
                yield pa.RecordBatch.from_arrays([ids, found, pa.array(np.where(known, near, 0.0)), pa.array(far | ~known)], names=["doc_id", "lang_pred", "score", "rejected"])

    return run


def identify(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, rejected)`` of every document.

    ``lang_pred`` is the nearest language, ``und`` for a text that is null or has no letter;
    ``score`` is the cosine to its nearest centroid; ``rejected`` marks texts that are farther
    from it than its radius, whose language is but a guess, and all ``und``. Of equally near
    languages the first by name counts. Rows with equal ids or texts are judged each; an empty
    table gives no rows; a model without languages gives ``und``; other columns are ignored.
    """
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(K.released(_judge(model)), "doc_id long, lang_pred string, score double, rejected boolean")
