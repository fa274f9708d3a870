"""A folder of statement files with layouts of their own, read in one scan.

A table gives the mapping of each file. A task takes whole files (uploads are some
megabytes), cuts them into records and picks the mapped fields by the file's own header;
amounts and dates are parsed by the same columns as for a single file. What cannot be read
goes to a side output with its file, line and reason, and stops nothing else.
"""

from __future__ import annotations

import csv
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright.functions.dates import parse_date
from ratewright.functions.text import normalize_merchant
from ratewright.sources import statements as S

#: Fields that a mapping can name, and what a scan gives of each record.
FIELDS = ["date", "merchant", "amount", "dc_indicator", "debit", "credit", "imported_id"]
RECORD = "file string, line int, layout string, sign_convention string, " + ", ".join(f"`{f}` string" for f in FIELDS) + ", raw string, problem string"


def records_of(text: str) -> Iterator[tuple[int, str, bool]]:
    """``(line, record, whole)``: a record ends with a line in which its quotes are closed.

    One whose quotes are still open at the end of the text is no record: its first line stands
    alone, as broken, and the next line begins anew.
    """
    lines = text.splitlines(keepends=True)
    at = 0
    while at < len(lines):
        quotes, end = lines[at].count('"'), at + 1
        while quotes % 2 and end < len(lines):
            quotes += lines[end].count('"')
            end += 1
        whole = quotes % 2 == 0
        end = end if whole else at + 1
        record = "".join(lines[at:end]).rstrip("\r\n")
        if record.strip():
            yield at + 1, record, whole
        at = end


def _fields(record: str) -> list[str] | None:
    try:
        rows = list(csv.reader(record.splitlines(keepends=True), strict=True))
    except csv.Error:
        return None
    return rows[0] if len(rows) == 1 else None


def _file(name: str, content: bytes, mapping: str | None) -> Iterator[dict]:
    """The records of a file; one row with a problem and no line if the file as a whole cannot be read."""
    try:
        known = S.Mapping.load(json.loads(mapping)) if mapping else None
    except (S.MappingError, ValueError, AttributeError) as e:
        yield {"file": name, "problem": f"mapping: {e}"}
        return
    if known is None:
        yield {"file": name, "problem": "no mapping"}
        return
    found = records_of(content.decode("utf-8-sig", "replace"))
    first = next(found, None)
    header = _fields(first[1]) if first and first[2] else None
    try:
        columns = known.resolve(header or [])
    except S.MappingError as e:
        yield {"file": name, "problem": str(e)}
        return
    place = {f: header.index(h) for f, h in columns.items() if f in FIELDS}
    base = {"file": name, "layout": known.layout, "sign_convention": known.sign_convention}
    for line, record, whole in found:
        fields = _fields(record) if whole else None
        if fields is None:
            yield base | {"line": line, "raw": record, "problem": "open quotes"}
        elif len(fields) != len(header):
            yield base | {"line": line, "raw": record, "problem": f"{len(fields)} fields, not {len(header)}"}
        else:
            yield base | {"line": line, "raw": record} | {f: fields[k] for f, k in place.items()}


def _scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["file", "line", "layout", "sign_convention", *FIELDS, "raw", "problem"]
    for part in parts:
        for name, content, mapping in zip(part["file"], part["content"], part["mapping"]):
            rows = list(_file(name, content, mapping))
            for at in range(0, len(rows), 10_000):
                out = pd.DataFrame(rows[at : at + 10_000], columns=names)
                yield out.astype({"line": "Int32"}).astype({c: object for c in names if c != "line"}).where(out.notna(), None)


def scan_folder(spark: SparkSession, path: str, mappings: DataFrame) -> DataFrame:
    """The records of all files below ``path`` (a folder, a pattern or several paths), with ``problem`` where one cannot be read.

    ``mappings(file, mapping)``: the name of a file and its mapping as JSON. Columns may differ
    from file to file, records may go over several lines. A file without records or with its
    header alone gives none.
    """
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    known = mappings.groupBy("file").agg(F.min("mapping").alias("mapping"))
    return files.join(known, "file", "left").select("file", "content", "mapping").mapInPandas(_scan, RECORD).withColumn("problem", _problem())


def _cents() -> Column:
    return (
        F.when(F.col("layout") == "indicator", S.indicator_amount(F.col("amount"), F.col("dc_indicator")))
        .when(F.col("layout") == "split", S.split_amount(F.col("debit"), F.col("credit")))
        .when(F.col("sign_convention") == "positive_is_debit", S.signed_amount(F.col("amount"), "positive_is_debit"))
        .otherwise(S.signed_amount(F.col("amount")))
    )


def _problem() -> Column:
    """The reason why a record cannot be read, its own or that it has no date or amount."""
    unread = F.when(parse_date(F.col("date")).isNull(), "no date").when(_cents().isNull(), "no amount")
    return F.coalesce(F.col("problem"), unread)


def transactions(records: DataFrame) -> DataFrame:
    """``(file, line, date, cents, imported_payee, merchant, imported_id)`` of the records that can be read."""
    return records.filter("problem is null").select(
        "file", "line", parse_date(F.col("date")).alias("date"), _cents().alias("cents"), F.trim("merchant").alias("imported_payee"),
        normalize_merchant(F.col("merchant")).alias("merchant"), F.nullif(F.trim("imported_id"), F.lit("")).alias("imported_id"),
    )


def problems(records: DataFrame) -> DataFrame:
    """``(file, line, problem, raw)`` of those that cannot; the line is null where it is the whole file."""
    return records.filter("problem is not null").select("file", "line", "problem", "raw")


def counts(records: DataFrame) -> DataFrame:
    """``(file, read, unread)``."""
    return records.groupBy("file").agg(F.count_if(F.col("problem").isNull()).alias("read"), F.count_if(F.col("problem").isNotNull()).alias("unread"))
