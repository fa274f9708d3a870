"""Concatenate-and-cut packing of tokenised texts.

Pass one tokenises every text once and writes the ids with running offsets inside
each partition. The partition totals (one row per partition) give every partition
its global offset by a prefix sum. Pass two cuts the written ids at multiples of
the sequence length; a text that crosses a cut yields one boundary record per
sequence. Only the last sequence can be short.
"""

from __future__ import annotations

import itertools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .storage import materialize

#: Words, and runs of them, whose ids a task remembers at most; when it is full, the older half goes.
MEMO = 600_000
#: Words of these characters split into runs by rule: printable ASCII, and the letters of Latin-1, which NFC leaves alone.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: The split pattern of the vocabulary, for lower-cased words of PLAIN characters.
RUN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


def forget(memo: dict) -> None:
    """The older half goes."""
    for key in list(itertools.islice(memo, len(memo) // 2)):
        del memo[key]


class WordTokenizer:
    """Ids of whole texts under a vocabulary that drops white space.

    No token spans white space under such a vocabulary, so a text's ids are those of its
    words in order, and a repeated word is encoded once. A word of PLAIN characters is
    lower-cased and split into runs that the vocabulary's model encodes on their own; any
    other word, and one that may hold a special token, is encoded by the tokenizer itself.
    """

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.encoder.get_vocab_size() <= 1 << 16 else np.uint32
        self.words: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.limit, self.part = memo, min(1 << 16, memo // 4)
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in printable]
        self.letter = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def _pack(self, ids: list[int]) -> bytes:
        return array(np.dtype(self.kind).char, ids).tobytes()

    def _run(self, run: str) -> bytes:
        ids = self.runs.get(run)
        if ids is None:
            letters = run if run.isascii() else "".join(map(self.letter.__getitem__, run.encode()))
            ids = self._pack([t.id for t in self.encoder.model.tokenize(letters)])
            if len(self.runs) >= self.limit // 2:
                forget(self.runs)
            self.runs[run] = ids
        return ids

    def _word(self, word: str) -> bytes:
        if "<|" not in word and PLAIN.fullmatch(word):
            return b"".join([self._run(r) for r in RUN.findall(word.lower())])
        return self._pack(self.encoder.encode(word, add_special_tokens=False).ids)

    def _part(self, words: list[bytes]) -> bytes:
        known = self.words
        ids = list(map(known.get, words))
        if None in ids:
            missing = {w for w, x in zip(words, ids) if x is None}
            if len(known) + len(missing) > self.limit:
                forget(known)
                missing = set(words) - known.keys()
            for w in missing:
                known[w] = self._word(w.decode())
            ids = list(map(known.get, words))
        return b"".join(ids)

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """The packed ids of each text."""
        for text in texts:
            words = text.split()
            yield b"".join(self._part(words[at : at + self.part]) for at in range(0, len(words), self.part))


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one a task: in a reused worker it and its words would take memory through all later stages
        t, part, at = WordTokenizer(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], t.kind).tobytes()
        width = np.dtype(t.kind).itemsize
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                texts = batch.column(1).slice(first, 256).cast(pa.binary()).to_pylist()
                ids = [x + end for x in t.encode([x or b"" for x in texts])]
                sizes = np.array([len(x) // width for x in ids], np.int64)
                starts = at + np.cumsum(sizes) - sizes
                at += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, 256),
                        pa.array(np.full(len(ids), part, np.int32)),
                        pa.array(starts),
                        pa.array(sizes),
                        pa.array(np.full(len(ids), width, np.int32)),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["doc_id", "part", "local", "doc_tokens", "width", "ids"],
                )

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        for batch in batches:
            cols = {k: batch.column(k).to_pylist() for k in ("doc_id", "base", "local", "doc_tokens", "width")}
            packed = batch.column("ids")
            out: dict[str, list] = {k: [] for k in names}
            held = 0
            for i in range(batch.num_rows):
                ids = np.frombuffer(packed[i].as_py(), np.uint16 if cols["width"][i] == 2 else np.uint32).astype("<u4")
                at, done, total = cols["base"][i] + cols["local"][i], 0, cols["doc_tokens"][i]
                while done < total:
                    sequence, offset = divmod(at + done, length)
                    size = min(length - offset, total - done)
                    row = (cols["doc_id"][i], done, size, total, sequence, offset, ids[done : done + size].tobytes())
                    for k, v in zip(names, row):
                        out[k].append(v)
                    done, held = done + size, held + size
                if held > 1 << 20 or i + 1 == batch.num_rows:
                    kinds = [pa.int64()] * 6 + [pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(names, kinds)], names=names)
                    out, held = {k: [] for k in names}, 0

    return run


def pack(documents: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces ``(doc_id, start, length, doc_tokens, sequence_id, offset, ids)``; ids are little-endian unsigned 32-bit.

    Every text is its ids and then ``end_id``; a null or empty text is ``end_id``
    alone. Rows with equal ids or texts are packed each on its own; an empty table
    gives no pieces; other columns are ignored.
    """
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, part int, local long, doc_tokens long, width int, ids binary"
    tokens = materialize(texts.mapInArrow(K.released(_encode(tokenizer_path, end_id)), schema), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))  # one row per partition
    placed = tokens.join(F.broadcast(bases), "part").select("doc_id", "base", "local", "doc_tokens", "width", "ids")
    return placed.mapInArrow(K.released(_cut(length)), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(pieces: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the packed sequences themselves, put together from their pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.expr("aggregate(parts, cast('' as binary), (s, x) -> concat(s, x.ids))").alias("ids"))
