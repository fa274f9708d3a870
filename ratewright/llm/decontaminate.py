"""Benchmark decontamination: n-gram seeds, then local alignment.

Every n-gram of the benchmark is looked for in every text, and each one found is a
seed: none is thinned out, as the one left out may be all that an edited copy kept.
Seeds join texts to items; Smith-Waterman alignment of words scores the stretch around
them, so edited copies count as well. Stretches that hold too few of an item's words to
reach the least score are not aligned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .storage import discard, materialize

#: Words of a seed.
SEED_WORDS = 3
#: Alignment scores for equal words, different words and skipped words.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least share of an item's own score.
SIMILARITY = 0.5
#: Distinct benchmark n-grams that may be broadcast (8 bytes each); beyond it all n-grams of the texts are joined.
BROADCAST_NGRAMS = 1 << 21
#: Rows of item n-grams that may be broadcast; beyond it they are dealt out so many times, as a frequent one meets many texts.
BROADCAST_SEEDS, SALTS = 1 << 18, 16
#: Text ids whose list may be broadcast.
BROADCAST_IDS = 1 << 20


def _words(column: pa.Array) -> Iterator[tuple[K.Slice, K.Words]]:
    """Slices of lower-cased texts with their words; only a slice of the texts is held lower-cased."""
    for part in K.slices(column):
        text = pa.Array.from_buffers(pa.large_string(), part.n, [None, pa.py_buffer(part.offsets), pa.py_buffer(part.data)])
        at = 0
        for s in K.slices(pc.utf8_lower(text)):  # more than one where texts grow by it
            s.first = part.first + at
            at += s.n
            yield s, K.words(s, K.NOT_ALNUM)


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s, w in _words(batch.column(1)):
            bounds = w.bounds(s.n)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.n), K.list_array(pa.array(w.hash.view(np.int64)), bounds)], names=["item_id", "item_words"])


def _ngram_rows(n: int, only: np.ndarray | None):
    """Positions of n-grams in texts; of those in ``only`` (sorted) if given."""
    if only is not None:
        gate = np.zeros(1 << 20, bool)
        gate[(only & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, w in _words(batch.column(1)):
                at, h = K.ngrams(w, n)
                if only is not None:
                    maybe = np.flatnonzero(gate[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
                    place = np.minimum(np.searchsorted(only, h[maybe]), max(0, len(only) - 1))
                    maybe = maybe[only[place] == h[maybe]] if len(only) else maybe[:0]
                    at, h = at[maybe], h[maybe]
                if len(at):
                    begin = w.bounds(s.n)[w.doc[at]]
                    ids = batch.column(0).slice(s.first, s.n).take(pa.array(w.doc[at]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(at - begin), pa.array(h.view(np.int64))], names=["key", "at", "gram"])

    return run


def align(item: np.ndarray, text: np.ndarray, anchored: bool = False) -> tuple[int, int, int]:
    """Best local alignment score with linear gaps, and where in ``item`` and in ``text`` it ends (row by row, vectorised).

    ``anchored``: the alignment begins where both begin.
    """
    slope = np.arange(len(text) + 1) * -GAP
    row = -slope if anchored else np.zeros(len(text) + 1, np.int64)
    floor = np.iinfo(np.int32).min if anchored else 0
    best, item_end, text_end = 0, 0, 0
    for i, word in enumerate(item):
        fresh = np.full(len(text) + 1, (i + 1) * GAP if anchored else 0, np.int64)
        fresh[1:] = np.maximum(row[:-1] + np.where(text == word, MATCH, MISMATCH), row[1:] + GAP)
        fresh = np.maximum(np.maximum.accumulate(np.maximum(fresh, floor) + slope) - slope, floor)
        top = int(fresh.argmax())
        if fresh[top] > best:
            best, item_end, text_end = int(fresh[top]), i + 1, top
        row = fresh
    return best, item_end, text_end


def begin(item: np.ndarray, text: np.ndarray, item_end: int, text_end: int) -> int:
    """Where in ``text`` the best alignment that ends at these places begins: the same alignment, backwards."""
    return text_end - align(item[:item_end][::-1], text[:text_end][::-1], anchored=True)[2]


def stretches(places: list[int], length: int, size: int) -> list[tuple[int, int]]:
    """Stretches of a text of ``size`` words around seed places, each wide enough for an item of ``length`` words on either side."""
    out: list[list[int]] = []
    for p in sorted(places):
        lo, hi = max(0, p - 2 * length), min(size, p + 2 * length + SEED_WORDS)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _score(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column(2).to_pylist()
            rows: dict[str, list] = {k: [] for k in ("row", "item_id", "score", "similarity", "start_word", "end_word")}
            for s, w in _words(batch.column(1)):
                cut = w.bounds(s.n)
                for i in range(s.n):
                    text = w.hash[cut[i] : cut[i + 1]].view(np.int64)
                    for found in items[s.first + i]:
                        item = np.array(found["item_words"], np.int64)
                        best = (0, 0, 0, 0)
                        for lo, hi in stretches(found["places"], len(item), len(text)):
                            if np.isin(item, text[lo:hi]).sum() / len(item) < similarity:
                                continue  # not even with all its words in order
                            score, item_end, end = align(item, text[lo:hi])
                            best = max(best, (score, item_end, lo, end), key=lambda b: b[0])
                        score, item_end, lo, end = best
                        share = score / (MATCH * len(item))
                        if share >= similarity:
                            start = lo + begin(item, text[lo:], item_end, end)
                            for k, v in zip(rows, (s.first + i, found["item_id"], score, share, start, lo + end)):
                                rows[k].append(v)
            of = pa.array(rows.pop("row"), pa.int64())
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            found = [pa.array(v, t) for v, t in zip(rows.values(), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(3).take(of), *found], names=["key", "doc_id", *rows])

    return run


def contaminated(
    documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, n: int = SEED_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, item_id, score, similarity, start_word, end_word)`` per text and benchmark item that it holds a copy of.

    Of several equal copies in a text the first is given. Null and empty texts match nothing; an item of fewer than ``n`` words has no seed
    and matches nothing; an empty table on either side gives no rows. Equal items and
    repeated rows match each on its own. Rows without an id, and rows that share one, are
    judged each by its own text. Other columns are ignored.
    """
    return _contaminated(documents, benchmark, similarity, n, id_col, text_col)[0].drop("key")


def row_key(id_col: str, text_col: str) -> Column:
    """What a row is known by within the operator: its id and its text, or its text alone; rows equal in both are judged alike."""
    own = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.lit("text"), text_col))
    return F.struct(own.alias("id"), F.xxhash64(text_col).alias("text"))


def _contaminated(documents: DataFrame, benchmark: DataFrame, similarity: float, n: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The result of :func:`contaminated` with each row's key, and the written table of seeds that it reads."""
    texts = documents.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id")).filter("text is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null").dropDuplicates(["item_id"])
    item_words = items.mapInArrow(K.released(_item_rows), "item_id long, item_words array<long>").filter(F.size("item_words") >= n)
    grams = items.select("item_id", "text").mapInArrow(K.released(_ngram_rows(n, None)), "key long, at long, gram long").withColumnRenamed("key", "item_id")
    distinct = grams.select("gram").distinct()
    only = None
    if distinct.count() <= BROADCAST_NGRAMS:
        only = np.unique(distinct.toArrow().column("gram").to_numpy().astype(np.int64).view(np.uint64))
    hits = texts.select("key", "text").mapInArrow(K.released(_ngram_rows(n, only)), "key struct<id:long,text:long>, at long, gram long")
    hits = hits if only is not None else hits.join(distinct, "gram", "left_semi").select("key", "at", "gram")
    hits = materialize(hits, "hits")  # read by the join and by the choice of texts
    seeds = grams.select("item_id", "gram").distinct()
    if seeds.count() <= BROADCAST_SEEDS:
        met = hits.join(F.broadcast(seeds), "gram")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        met = hits.withColumn("salt", F.pmod(F.xxhash64("key", "at"), F.lit(SALTS)).cast("int")).join(seeds.withColumn("salt", salts), ["gram", "salt"])
    pairs = met.groupBy("key", "item_id").agg(F.collect_list("at").alias("places"))
    listed = pairs.join(item_words, "item_id").groupBy("key").agg(F.collect_list(F.struct("item_id", "item_words", "places")).alias("items"))
    keys = hits.select("key").distinct()
    size = keys.count()
    wanted = texts.join(F.broadcast(keys) if size <= BROADCAST_IDS else keys, "key", "left_semi")
    schema = "key struct<id:long,text:long>, doc_id long, item_id long, score long, similarity double, start_word long, end_word long"
    return wanted.join(listed, "key").select("key", "text", "items", "doc_id").mapInArrow(K.released(_score(similarity)), schema), hits


def drop_contaminated(
    documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, n: int = SEED_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``documents`` that hold no copy of a benchmark item, with their own columns; each row by its own text, with an id or without."""
    found, hits = _contaminated(documents, benchmark, similarity, n, id_col, text_col)
    found = materialize(found.select(F.col("key").alias("__key")).distinct(), "contaminated")
    discard(hits)
    keyed = documents.withColumn("__key", row_key(id_col, text_col))
    return keyed.join(F.broadcast(found) if found.count() <= BROADCAST_IDS else found, "__key", "left_anti").select(documents.columns)
