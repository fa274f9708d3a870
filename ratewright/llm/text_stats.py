"""Counts over words, lines and characters of whole texts, for a slice of a batch at a time."""

from __future__ import annotations

import numpy as np

from . import kernels as K

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"


def byte_class(members: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


_SYMBOL = byte_class(SYMBOLS)
_BANG = byte_class(b"!?")
_DIGIT = byte_class(b"0123456789")
_UPPER = byte_class(bytes(range(65, 91)))
_LETTER = byte_class(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_STOP = byte_class(b".,;:!?")


def running(mask: np.ndarray) -> np.ndarray:
    """How many bytes before each place, and in all, are in a mask."""
    total = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, dtype=np.int32, out=total[1:])
    return total


def per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text are in a mask."""
    total = running(mask)
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether another is equal, and whether an earlier one is."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:]] = same
    any_[order[1:]] = same
    any_[order[:-1]] |= same
    return any_, again


def lines_with_words(s: K.Slice, w: K.Words) -> tuple[K.Words, np.ndarray]:
    """The lines that hold a word, and the line of each word."""
    lines = K.words(s, K.NEWLINE, lower=False)
    of = np.searchsorted(lines.start, w.start, side="right") - 1
    held = np.bincount(of, minlength=len(lines.start)) > 0
    renumber = np.cumsum(held) - 1
    return K.Words(lines.start[held], lines.end[held], lines.doc[held], lines.hash[held]), renumber[of]


def covered(w: K.Words, size: int = 8) -> np.ndarray:
    """Words inside a window of ``size`` words that its text holds twice or more."""
    at, h = K.ngrams(w, size)
    twice, _ = repeated(K.combine([h, w.doc[at].astype(np.uint64)]))
    first, n = at[twice], len(w.doc) + 1
    step = np.bincount(first, minlength=n) - np.bincount(first + size, minlength=n)
    return np.cumsum(step[:-1]) > 0


def base_counts(s: K.Slice, w: K.Words, lines: K.Words) -> dict[str, np.ndarray]:
    """The counts of the quality rules, per text; ``w``: its words, ``lines``: its lines that hold one."""
    points = running((s.data & 0xC0) != 0x80)
    _, again = repeated(K.combine([lines.hash, lines.doc.astype(np.uint64)]))
    return {
        "n_words": np.bincount(w.doc, minlength=s.n),
        "word_chars": np.bincount(w.doc, weights=points[w.end] - points[w.start], minlength=s.n).astype(np.int64),
        "n_symbols": per_text(_SYMBOL[s.data], s.offsets),
        "n_dup_lines": np.bincount(lines.doc[again], minlength=s.n),
        "n_repeat_words": np.bincount(w.doc[covered(w)], minlength=s.n),
    }


#: Names of the columns that line_features() and text_features() give.
FEATURES = ["upper", "symbol", "bang", "digit", "letter", "word_length", "symbol_words", "same_next", "distinct", "stop_words", "long_words", "log_words", "bias"]
#: Those of a line: the same, and whether an earlier line of its text is equal.
LINE_FEATURES = [*FEATURES, "again"]


def _shares(s: K.Slice, w: K.Words, unit: np.ndarray, n: int) -> np.ndarray:
    """Features of each unit (a line or a text) from the words that lie in it."""
    def bytes_in(mask: np.ndarray) -> np.ndarray:
        total = running(mask)
        return np.bincount(unit, weights=total[w.end] - total[w.start], minlength=n)

    words = np.maximum(1, np.bincount(unit, minlength=n)).astype(float)
    size = np.maximum(1, np.bincount(unit, weights=w.end - w.start, minlength=n))
    letters = np.maximum(1, bytes_in(_LETTER[s.data]))
    symbol = running(_SYMBOL[s.data] | _BANG[s.data])
    stop = np.zeros(0, bool) if not len(w.end) else _STOP[s.data[w.end - 1]]
    same = np.zeros(len(unit), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (unit[1:] == unit[:-1])
    _, again = repeated(K.combine([w.hash, unit.astype(np.uint64)]))
    return np.stack(
        [
            bytes_in(_UPPER[s.data]) / letters,
            np.minimum(1, 4 * bytes_in(_SYMBOL[s.data]) / size),
            np.minimum(1, 4 * bytes_in(_BANG[s.data]) / size),
            bytes_in(_DIGIT[s.data]) / size,
            letters / size,
            np.minimum(2, size / words / 8),
            np.bincount(unit, weights=symbol[w.end] > symbol[w.start], minlength=n) / words,
            np.bincount(unit, weights=same, minlength=n) / words,
            1 - np.bincount(unit, weights=again, minlength=n) / words,
            np.bincount(unit, weights=stop, minlength=n) / words,
            np.bincount(unit, weights=(w.end - w.start) > 24, minlength=n) / words,
            np.log1p(words) / 8,
            np.ones(n),
        ],
        axis=1,
    )


def line_features(s: K.Slice, w: K.Words, lines: K.Words, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every line with a word, and its number of words; ``unit``: the line of each word."""
    _, again = repeated(K.combine([lines.hash, lines.doc.astype(np.uint64)]))
    shares = np.concatenate([_shares(s, w, unit, len(lines.doc)), again[:, None]], axis=1)
    return shares, np.bincount(unit, minlength=len(lines.doc))


def text_features(s: K.Slice) -> np.ndarray:
    """Features of every text, with its shares of repeated words and lines."""
    w = K.words(s, lower=False)
    lines, _ = lines_with_words(s, w)
    base = base_counts(s, w, lines)
    shares = _shares(s, w, w.doc, s.n)
    shares[base["n_words"] == 0, :-1] = 0
    words = np.maximum(1, base["n_words"])
    per_line = np.maximum(1, np.bincount(lines.doc, minlength=s.n))
    return np.concatenate([shares[:, :-1], (base["n_repeat_words"] / words)[:, None], (base["n_dup_lines"] / per_line)[:, None], (base["n_words"] > 0)[:, None]], axis=1)
