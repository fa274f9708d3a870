"""Toxic passages by maximum-scoring segments of token log-odds.

Words and word beginnings are hashed into a fixed number of buckets. Counts of all
labelled texts give each bucket a log-odds ratio under an informative Dirichlet
prior; ratios that are not significant count nothing. A linear scan finds every
maximal segment of a text (Ruzzo and Tompa), and extreme-value statistics of
segment scores turn the best one into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .labelled import known_labels, labelled_sample

#: Buckets of the count table; it bounds what the driver holds and broadcasts.
BUCKETS = 1 << 20
#: Strength of the prior, in tokens; least significance of a ratio; cost of every token in a segment.
PRIOR, SIGNIFICANT, DRIFT = 500.0, 4.0, 0.5
#: Bytes of a word's beginning.
STEM = 5
#: Labelled texts of each class that the calibration looks at.
SAMPLE_TEXTS = 3000
#: A passage is significant when so many or fewer of its score are expected in a clean text.
SIGNIFICANT_E = 0.01

#: Labelled ids that may be broadcast; beyond it labels and texts meet in a shuffle.
BROADCAST_LABELS = 1 << 20

_SEPARATORS = K.NOT_ALNUM.copy()


def tokens(s: K.Slice) -> tuple[K.Words, np.ndarray, np.ndarray]:
    """Words of lower-cased texts, with the buckets of each word and of its beginning."""
    w = K.words(s, _SEPARATORS, stem=STEM)
    word = (K.combine([w.hash], salt=1) % np.uint64(BUCKETS)).astype(np.int64)
    stem = (K.combine([w.stem], salt=2) % np.uint64(BUCKETS)).astype(np.int64)
    return w, word, stem


def _slices(batch: pa.RecordBatch) -> Iterator[K.Slice]:
    for s in K.slices(pc.utf8_lower(batch.column(1))):
        yield s


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and clean texts each bucket occurs, one row per bucket and task."""
    seen = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        labels = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
        for s in _slices(batch):
            w, word, stem = tokens(s)
            of = np.concatenate([w.doc, w.doc])
            once = np.unique(of * BUCKETS + np.concatenate([word, stem]))
            label = labels[s.first + once // BUCKETS]
            for k in (0, 1):
                seen[k] += np.bincount(once[label == k] % BUCKETS, minlength=BUCKETS)
    found = np.flatnonzero(seen.sum(axis=0))
    for at in range(0, len(found), 1 << 16):
        part = found[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(seen[0, part]), pa.array(seen[1, part])], names=["bucket", "clean", "toxic"])


@dataclass
class ToxicityModel:
    """Token weights by bucket, and the extreme-value law of the best segment of a clean text."""

    weights: np.ndarray
    rate: float
    scale: float
    limit: float

    def token_scores(self, word: np.ndarray, stem: np.ndarray) -> np.ndarray:
        a, b = self.weights[word], self.weights[stem]
        return np.where(np.abs(a) >= np.abs(b), a, b).astype(float) - DRIFT

    def log_e(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Logarithm of the number of segments of at least that score that ``n`` clean tokens hold on average."""
        return np.log(self.scale * np.maximum(1, n)) - self.rate * best

    def probability(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.limit - self.log_e(best, n), -50, 50)))


def log_odds(clean: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Log-odds ratios under a Dirichlet prior in proportion to all counts; 0 where not significant."""
    c, t = clean.sum(), toxic.sum()
    if not c or not t:
        return np.zeros(len(clean), np.float32)
    prior = PRIOR * (clean + toxic) / (c + t) + 1e-9
    x, y = toxic + prior, clean + prior
    ratio = np.log(x / (t + PRIOR - x)) - np.log(y / (c + PRIOR - y))
    z = ratio / np.sqrt(1 / x + 1 / y)
    return np.where((z >= SIGNIFICANT) & (toxic >= 3), ratio, 0).astype(np.float32)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)``, in linear time."""
    stack: list[list[float]] = []  # start, end, total before, total after
    total = 0.0
    for i, x in enumerate(scores.tolist()):
        before, total = total, total + x
        if x <= 0:
            continue
        new = [i, i + 1, before, total]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                stack.append([*new, j])
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
    return [(int(a), int(b), hi - lo) for a, b, lo, hi, _ in stack]


def best_segments(scores: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The best segment score of each of ``n`` texts, 0 if none is positive; one pass over all tokens."""
    out = np.zeros(n)
    if len(scores):
        total = np.cumsum(scores)
        apart = doc * (np.abs(scores).sum() + 1)
        low = np.minimum.accumulate(np.concatenate([[0.0], total[:-1]]) - apart)
        np.maximum.at(out, doc, total - apart - low)
    return out


def _best(model: ToxicityModel, with_label: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in _slices(batch):
                w, word, stem = tokens(s)
                scores = model.token_scores(word, stem)
                best = best_segments(scores, w.doc, s.n)
                n = np.bincount(w.doc, minlength=s.n)
                if with_label:
                    yield pa.RecordBatch.from_arrays([batch.column(2).slice(s.first, s.n), pa.array(best), pa.array(n)], names=["label", "best", "n"])
                    continue
                cut, log_e, rows = w.bounds(s.n), model.log_e(best, n), []
                allowed = np.log(SIGNIFICANT_E)
                for i in range(s.n):
                    found = segments(scores[cut[i] : cut[i + 1]]) if best[i] > 0 and log_e[i] <= allowed else []
                    chars = np.cumsum((s.data[s.offsets[i] : s.offsets[i + 1]] & 0xC0) != 0x80) if found else None
                    rows.append([])
                    for a, b, score in found:
                        e = float(model.log_e(np.array([score]), n[i : i + 1])[0])
                        if e <= allowed:
                            lo, hi = w.start[cut[i] + a] - s.offsets[i], w.end[cut[i] + b - 1] - s.offsets[i]
                            rows[-1].append({"start": int(chars[lo]) - 1, "end": int(chars[hi - 1]), "score": score, "log_e": e})
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("log_e", pa.float64())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s.first, s.n), pa.array(n), pa.array(best), pa.array(model.probability(best, n)), pa.array(rows, kind)],
                    names=["doc_id", "n_tokens", "best", "score", "passages"],
                )

    return run


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE_TEXTS, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Counts over all labelled texts; calibration on at most ``sample`` texts of each class."""
    known = known_labels(labels, "toxic", id_col)
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = F.broadcast(known) if known.count() <= BROADCAST_LABELS else known
    counts = texts.join(known, "doc_id").select("doc_id", "text", "label").mapInArrow(K.released(_count), "bucket int, clean long, toxic long")
    rows = counts.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    clean, toxic = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    at = rows.column("bucket").to_numpy()
    clean[at], toxic[at] = rows.column("clean").to_numpy(), rows.column("toxic").to_numpy()
    model = ToxicityModel(log_odds(clean, toxic), 1.0, 1.0, 0.0)
    sampled = labelled_sample(documents, labels, "toxic", sample, id_col, text_col)
    best = sampled.mapInArrow(K.released(_shared_best(documents.sparkSession, model, True)), "label int, best double, n long").toArrow()
    return calibrate(model, *(best.column(c).to_numpy() for c in ("best", "n", "label")))


def _shared_best(spark: SparkSession, model: ToxicityModel, with_label: bool):
    """:func:`_best` with the model as a broadcast of BUCKETS weights of 4 bytes each, 4 MB whatever the corpus."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _best(shared.value, with_label)(batches)

    return run


def calibrate(model: ToxicityModel, best: np.ndarray, n: np.ndarray, label: np.ndarray) -> ToxicityModel:
    """Gumbel rate and scale from the clean texts' best segments (moments), and the limit that parts the classes best."""
    clean = label == 0
    if not clean.any() or clean.all():
        model.limit = -1e9 if clean.all() or not len(label) else 0.0
        return model
    spread = max(0.25, float(best[clean].std()))
    model.rate = float(np.pi / np.sqrt(6) / spread)
    mode = float(best[clean].mean()) - 0.5772 / model.rate
    model.scale = float(np.exp(model.rate * mode) / max(1.0, n[clean].mean()))
    e = model.log_e(best, n)
    # clean texts are far more frequent than toxic ones, so a false alarm weighs more
    cuts = np.unique(e)
    cuts = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1]])
    hit = np.searchsorted(np.sort(e[~clean]), cuts) / (~clean).sum()
    false = np.searchsorted(np.sort(e[clean]), cuts) / clean.sum()
    gain = hit - 3 * false
    top = np.flatnonzero(gain >= gain.max() - 1e-12)
    model.limit = float(cuts[top[len(top) // 2]])
    return model


def toxicity(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: ToxicityModel | None = None) -> DataFrame:
    """``(doc_id, n_tokens, best, score, passages)`` for every row; passages are code point spans.

    Null and empty texts have no tokens, no passages and the score of no evidence.
    Repeated rows are scored each; an empty table gives no rows; other columns are
    ignored. Without labels of both classes no text is toxic.
    """
    model = model or fit(documents, labels, id_col=id_col, text_col=text_col)
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(K.released(_shared_best(documents.sparkSession, model, False)), "doc_id long, n_tokens long, best double, score double, passages array<struct<start:long,end:long,score:double,log_e:double>>")
