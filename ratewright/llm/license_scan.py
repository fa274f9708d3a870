"""Licence recognition by sentence rules (DataFrame functions only).

Texts are normalised with their sentence ends and line breaks marked. Known licence
sentences that stand between two marks, wrapped or not, become identifiers; what lies
between them is counted in lines. The identifier sequence of a text is matched against
ordered rules, the longest first, and what one rule has matched is not there for the
next. All of it is a projection: no shuffle, no Python.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from itertools import chain
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import RULES, SENTENCES, TEXTS

#: Lines or sentences, known or not, that may stand between two sentences of a rule.
GAP = 8
#: A sentence ends at a semicolon or colon, or a point before white space or the end.
SENTENCE_END = r"[;:]|\.(?=\s|\z)"
#: A line break and the comment marks after it; a sentence may end there, or go on.
LINE_BREAK = r"(?:\r\n?|\n)[^a-z0-9\r\n]*(?:(?:dnl|rem)\b[^a-z0-9\r\n]*)?"


def normalised(sentence: str) -> str:
    """What ``marked`` makes of a sentence inside of its marks; for the fixed sentences only."""
    return " ".join("".join(c.lower() if c.isascii() and c.isalnum() else " " for c in sentence).split())


def catalogue(texts: list[tuple[str, str]] = TEXTS, sentences: list[tuple[str, str]] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """Identifier by normalised sentence, and rules, longest first; a whole text is a rule of all its sentences.

    Sentences of texts that ``sentences`` does not name are named after the first licence that has them.
    """
    known: dict[str, str] = {}
    for name, sentence in sentences:
        known.setdefault(normalised(sentence), name)
    whole = []
    for license, text in texts:
        parts = [p for p in map(normalised, re.split(SENTENCE_END.replace(r"\z", r"\Z") + r"|\n", text)) if p]
        for k, part in enumerate(parts):
            known.setdefault(part, f"{license.lower()}-s{k + 1}")
        whole.append((license, [known[p] for p in parts]))
    return known, sorted([*whole, *rules], key=lambda rule: -len(rule[1]))


def marked(text: Column) -> Column:
    """Lower-case ASCII words with single spaces; `` | `` for sentence ends and `` / `` for line breaks, one of these at both ends."""
    lines = F.regexp_replace(F.concat(F.lit("\n"), F.translate(F.lower(text), "|/", "  ")), LINE_BREAK, " / ")
    plain = F.regexp_replace(F.regexp_replace(lines, SENTENCE_END, " | "), "[^a-z0-9|/]+", " ")
    return F.concat(F.trim(plain), F.lit(" /"))


def telling_words(known: list[str], least: int = 7) -> list[str]:
    """Words of which every known sentence holds one; long ones that many sentences share, chosen greedily."""
    left = [[w for w in set(s.split()) if len(w) >= least] or [max(s.split(), key=lambda w: (len(w), w))] for s in known if s]
    out = []
    while left:
        count = Counter(chain.from_iterable(left))
        out.append(max(count, key=lambda w: (count[w], len(w), w)))
        left = [words for words in left if out[-1] not in words]
    return out


def _alternatives(known: list[str]) -> str:
    """A pattern of all sentences, longest first, parted by first word; a line break may stand between any two words."""
    wrapped = "(?: | / )"
    by_word: dict[str, list[str]] = {}
    for s in sorted(known, key=lambda s: (-len(s), s)):
        first, _, rest = s.partition(" ")
        by_word.setdefault(first, []).append((wrapped + rest.replace(" ", wrapped) if rest else "") + "(?= [|/])")
    return "|".join(f"{word}(?:{'|'.join(rest)})" for word, rest in by_word.items())


def scan(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sentences: list[tuple[str, str]] = SENTENCES,
    rules: list[tuple[str, list[str]]] = RULES,
    texts: list[tuple[str, str]] = TEXTS,
) -> DataFrame:
    """``(doc_id, sentence_ids, license, n_licenses)`` for every row of ``documents``.

    ``sentence_ids`` is the comma-joined identifier sequence, empty for null, empty and
    unlicensed texts, whose ``license`` is null; else it is that of the first rule that
    matches, and ``n_licenses`` the number of distinct licences of all that do. Repeated
    rows are scanned each; an empty table gives no rows; other columns are ignored.
    """
    known, ordered = catalogue(texts, sentences, rules)
    table = F.create_map(*(F.lit(x) for x in chain.from_iterable(known.items())))
    units = F.regexp_extract_all(marked(F.col(text_col)), F.lit(rf"(?<=[|/] )(?:{_alternatives(list(known))})|[^|/ ][^|/]*"), F.lit(0))
    names = F.transform(units, lambda s: F.coalesce(F.try_element_at(table, F.replace(s, F.lit(" / "), F.lit(" "))), F.lit("?")))
    may = reduce(or_, (F.lower(text_col).contains(w) for w in telling_words(list(known))), F.lit(False))
    row = documents.select(F.col(id_col).alias("doc_id"), F.when(may, names).alias("names"))
    ids = F.array_join(F.filter("names", lambda s: s != "?"), ",")
    row = row.select("doc_id", F.coalesce(ids, F.lit("")).alias("sentence_ids"), F.concat(F.lit(","), F.array_join("names", ","), F.lit(",")).alias("sequence"))

    between = rf"(?:[^,]+,){{0,{GAP}}}?"
    patterns = F.array(*(F.struct(F.lit(license).alias("license"), F.lit("," + f",{between}".join(map(re.escape, wanted)) + ",").alias("pattern")) for license, wanted in ordered))
    start = F.struct(F.col("sequence").alias("rest"), F.array().cast("array<string>").alias("found"))

    def match(state: Column, rule: Column) -> Column:
        hit = F.regexp_like(state["rest"], rule["pattern"])
        rest = F.when(hit, F.regexp_replace(state["rest"], rule["pattern"], F.lit(",?,"))).otherwise(state["rest"])
        return F.struct(rest.alias("rest"), F.when(hit, F.concat(state["found"], F.array(rule["license"]))).otherwise(state["found"]).alias("found"))

    found = F.when(F.col("sentence_ids") != "", F.array_distinct(F.aggregate(patterns, start, match)["found"])).otherwise(F.array().cast("array<string>"))
    out = row.select("doc_id", "sentence_ids", found.alias("licenses"))
    return out.select("doc_id", "sentence_ids", F.get("licenses", F.lit(0)).alias("license"), F.size("licenses").cast("long").alias("n_licenses"))
