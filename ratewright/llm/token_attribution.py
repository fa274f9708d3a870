"""Offset-mapped token counts per section of a text.

Each text is encoded once, as a whole. The byte lengths of its tokens give every
token its span, and an interval join of spans with the sections of the text
attributes tokens. A token that crosses a section border counts where most of its
bytes lie; on equal shares, in the earlier section.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

_encodings: dict[tuple[str, str], tuple] = {}


def encoding(path: str, pattern: str):
    """The encoding of a rank file and the byte length of each of its ids."""
    if (path, pattern) not in _encodings:
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _encodings[path, pattern] = tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes
    return _encodings[path, pattern]


def attribute(ends: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """The section of each token. ``ends``: where tokens end; ``borders``: where sections begin, and the end of the last."""
    starts = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(borders, starts, side="right") - 1
    last = np.searchsorted(borders, ends - 1, side="right") - 1
    out = first.copy()
    for i in np.flatnonzero(first < last):
        edges = np.clip(borders[first[i] : last[i] + 2], starts[i], ends[i])
        out[i] = first[i] + int(np.argmax(np.diff(edges)))
    return out


def _count(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sizes = encoding(path, pattern)
        for batch in batches:
            for s in K.slices(batch.column(1)):
                ids = batch.column(0).slice(s.first, s.n)
                rows: list[list[np.ndarray]] = [[], [], [], []]
                for i in range(s.n):
                    raw = s.data[s.offsets[i] : s.offsets[i + 1]]
                    if not len(raw):
                        continue
                    tokens = np.array(encoder.encode_ordinary(raw.tobytes().decode()), np.int64)
                    lines = np.flatnonzero(raw == 10) + 1
                    borders = np.unique(np.concatenate([[0], lines, [len(raw)]]))
                    section = attribute(np.cumsum(sizes[tokens]), borders)
                    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    n = len(borders) - 1
                    rows[0].append(np.full(n, i))
                    rows[1].append(np.arange(n))
                    rows[2].append(np.diff(chars[borders]))
                    rows[3].append(np.bincount(section, minlength=n))
                if rows[0]:
                    of, *rest = (np.concatenate(x) for x in rows)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), *map(pa.array, rest)], names=["doc_id", "section", "n_chars", "n_tokens"])

    return run


def section_tokens(documents: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, section, n_chars, n_tokens)`` per line of each text, counted from 0; a line holds its line break.

    Null and empty texts have no sections. Sections whose characters all went to a
    neighbour's token count 0 tokens. Repeated rows are counted each; other columns
    are ignored.
    """
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(K.released(_count(rank_path, pattern)), "doc_id long, section long, n_chars long, n_tokens long")


def field_tokens(rows: DataFrame, fields: list[str], rank_path: str, pattern: str, id_col: str) -> DataFrame:
    """Tokens per field: the fields of a row are encoded as one text, one field a line, and attributed back."""
    text = F.array_join(F.array(*(F.regexp_replace(F.coalesce(F.col(f).cast("string"), F.lit("")), "\n", " ") for f in fields)), "\n")
    joined = rows.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    names = F.array(*map(F.lit, fields))
    return section_tokens(joined, rank_path, pattern).select("doc_id", F.get(names, F.col("section").cast("int")).alias("field"), "n_chars", "n_tokens")
