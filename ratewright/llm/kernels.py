"""Vectorised word tables over Arrow string columns (numpy, used inside tasks).

A batch of texts is cut into slices of half a megabyte (a longer text is one slice);
each slice becomes flat arrays of word boundaries and 64-bit word hashes, hashed block
by block so that a task holds little beside the text. Hashes depend on nothing but the
bytes of a word, so they agree across processes and runs.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 512 << 10
#: Bytes hashed at a time, and the bytes beyond which a word is digested on its own.
BLOCK, LONG_WORD = 256 << 10, 4096

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)

#: \x20 and \x09 to \x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII that is neither a letter nor a digit.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
NEWLINE = np.zeros(256, dtype=bool)
NEWLINE[0x0A] = True

#: Powers of the hash's odd multiplier, modulo 2**64.
_POWERS = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(LONG_WORD, _P)]))


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (splitmix finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def combine(parts: list[np.ndarray], salt: int = 0) -> np.ndarray:
    """One hash of a sequence of hashes; order counts."""
    h = np.full(len(parts[0]), np.uint64(salt * 2 + 1), dtype=np.uint64)
    for x in parts:
        h = mix(h * _M3 + x)
    return h


@dataclass
class Slice:
    """Consecutive texts of a batch: ``offsets`` has one entry more than texts."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Words:
    """Words of a slice, in order: byte bounds, text index, hash, and the hash of the beginning if asked for."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    stem: np.ndarray | None = None

    def bounds(self, n: int) -> np.ndarray:
        """Where each of ``n`` texts begins and ends among the words."""
        return np.searchsorted(self.doc, np.arange(n + 1))


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[Slice]:
    """Texts as bytes, nulls as empty, in slices of about SLICE_BYTES (one text at least)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        to = min(to, len(column))
        yield Slice(at, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def _blocks(start: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of words that begin within BLOCK bytes of each other; a long word is a range of its own."""
    long = np.flatnonzero(size > LONG_WORD)
    cuts = np.searchsorted(start, np.arange(start[0], start[-1] + 1, BLOCK))
    cuts = np.unique(np.concatenate([cuts, long, long + 1, [0, len(start)]]))
    yield from zip(cuts[:-1].tolist(), cuts[1:].tolist())


def words(s: Slice, separators: np.ndarray = SPACE, lower: bool = True, stem: int | None = None) -> Words:
    """Maximal runs of bytes that are no separators, never across texts; ``stem``: also hash so many first bytes of each."""
    size = len(s.data)
    apart = separators[s.data]
    breaks = np.zeros(size + 1, dtype=bool)
    breaks[s.offsets] = True
    edge = breaks[:-1].copy()
    edge[1:] |= apart[:-1]
    start = np.flatnonzero(edge & ~apart)
    if not len(start):
        none = np.zeros(0, np.uint64)
        return Words(start, start, start, none, none if stem else None)
    edge = breaks[1:]
    edge[:-1] |= apart[1:]
    end = np.flatnonzero(edge & ~apart) + 1
    doc = np.searchsorted(s.offsets, start, side="right") - 1
    table, length = _BYTE_LOWER if lower else _BYTE, end - start
    h = np.empty(len(start), np.uint64)
    h_stem = np.empty(len(start), np.uint64) if stem else None
    for i, j in _blocks(start, length):
        lo, hi = start[i], end[j - 1]
        if hi - lo > LONG_WORD and j - i == 1:
            whole = s.data[lo:hi]
            h[i] = int.from_bytes(hashlib.blake2b((_LOWER[whole] if lower else whole).tobytes(), digest_size=8).digest(), "little")
            if stem:
                h_stem[i] = (table[whole[:stem]] * _POWERS[:stem]).sum()
            continue
        first = start[i:j] - lo
        values = table[s.data[lo:hi]]
        values[apart[lo:hi]] = 0
        place = np.arange(hi - lo, dtype=np.int32)
        place -= np.repeat(first.astype(np.int32), np.diff(np.append(first, hi - lo)))
        values *= _POWERS[np.minimum(place, LONG_WORD, out=place)]  # places beyond a word are separators
        h[i:j] = np.add.reduceat(values, first)
        if stem:
            values[place >= stem] = 0
            h_stem[i:j] = np.add.reduceat(values, first)
    w = Words(start, end, doc, mix(h + length.astype(np.uint64)))
    if stem:
        w.stem = mix(h_stem + np.minimum(length, stem).astype(np.uint64))
    return w


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first words of all n-grams within one text, and their hashes."""
    if len(w.doc) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = combine([w.hash[i : len(w.hash) - n + 1 + i] for i in range(n)], salt=n)
    at = np.flatnonzero(w.doc[: len(w.doc) - n + 1] == w.doc[n - 1 :])
    return at, h[at]


def release() -> None:
    """Give freed memory back to the system: Python workers are reused, and would hold it through all later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this C library


def released(run: Callable) -> Callable:
    """A function over the batches of a partition that releases memory when it ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def released_after(run: Callable[[pa.Table], pa.Table], nbytes: int = 4 << 20) -> Callable[[pa.Table], pa.Table]:
    """A function over groups that releases memory after each large one."""

    def wrapped(table: pa.Table) -> pa.Table:
        out = run(table)
        if table.nbytes > nbytes:
            release()
        return out

    return wrapped


def list_array(flat: pa.Array, bounds: np.ndarray) -> pa.Array:
    """A list column over ``flat`` cut at ``bounds``."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), flat)
