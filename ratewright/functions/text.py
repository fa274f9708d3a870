"""Merchant names: normal form, canonical form, and longest common subsequences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Words that say nothing about a merchant.
NOISE = ["com", "net", "org", "mktp", "supercenter", "neighborhood", "inc", "llc", "corp", "ltd", "us", "usa"]


def title_case(text: Column) -> Column:
    """Each part between spaces and hyphens with a capital first letter and small ones after it."""

    def part(s: Column) -> Column:
        return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1_000_000)))

    def word(w: Column) -> Column:
        return F.array_join(F.transform(F.split(w, "-"), part), "-")

    return F.array_join(F.transform(F.split(text, " "), word), " ")


def normalize_merchant(payee: Column) -> Column:
    """Separators become spaces, white space is collapsed, then other signs go; title case.

    Collapsing comes first, so a sign that stood alone leaves two spaces.
    """
    spaced = F.trim(F.regexp_replace(F.regexp_replace(payee, r"[.*/]", " "), r"\s+", " "))
    return title_case(F.regexp_replace(spaced, r"[^\p{L}\p{N}\s&-]", ""))


def canonical_merchant(merchant: Column) -> Column:
    """Without noise words and plain numbers; unchanged where nothing else is left."""
    tokens = F.filter(F.split(F.trim(merchant), r"\s+"), lambda t: ~F.lower(t).isin(NOISE) & ~t.rlike(r"\A[0-9]+\z"))
    return F.when(F.size(tokens) > 0, F.array_join(tokens, " ")).otherwise(merchant)


def display_name(name: Column, email: Column) -> Column:
    """A person's name, or else the address."""
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), email)


def initials(name: Column, email: Column) -> Column:
    """First letters of the first and last word of a name; of one word, or else of the address, the first two; upper case."""
    words = F.split(F.trim(name), r"\s+")
    pair = F.concat(F.left(F.get(words, F.lit(0)), F.lit(1)), F.left(F.element_at(words, -1), F.lit(1)))
    address = F.when(F.length(email) >= 2, F.left(email, F.lit(2))).otherwise("?")
    named = F.when(F.size(words) >= 2, pair).otherwise(F.left(F.trim(name), F.lit(2)))
    return F.upper(F.when(F.length(F.trim(F.coalesce(name, F.lit("")))) > 0, named).otherwise(F.coalesce(address, F.lit("?"))))


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence; one addition on bit rows per character of ``b``."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two strings, null if one is null; no built-in has it."""
    return pd.Series([None if x is None or y is None else _lcs(x, y) for x, y in zip(a, b)], dtype="Int32")


def lcs_ratio(a: Column, b: Column) -> Column:
    """Common subsequence over the longer string; 0 for two empty strings."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(0.0)).otherwise(lcs_length(a, b) / longer)
