"""Statement files of different layouts in one scan."""

import json

from ratewright.sources import folder

FILES = {
    "signed.csv": 'Date,Payee,Amount,Ref\n2025-03-01,"Harbour, Books",-12.50,a1\n2025-03-02,"Two\nlines",3.00,\n2025-03-03,Short,1.00\n"2025-03-04,Open,5.00,x\n2025-03-05,Last,7.00,a5\nsoon,No day,1.00,a6\n2025-03-06,No amount,many,a7\n\n',
    "indicator.csv": "﻿ Posted ;x\n",
    "parts.csv": "When,What,Type,Sum\n03/01/2025,Mill,DR,4.00\n03/02/2025,Pay,CR,\"1,000.00\"\n",
    "split.csv": "day,out,in,text\r\n1-Mar-2025,5.25,,Kiosk\r\n2-Mar-2025,,7.00,Pay\r\n3-Mar-2025,,,Nothing\r\n",
    "unmapped.csv": "a,b\n1,2\n",
    "wrong.csv": "Date,Payee\n2025-01-01,x\n",
    "empty.csv": "",
}
SIGNED = {"layout": "signed", "fields": {"date": "Date", "merchant": "Payee", "amount": "Amount", "imported_id": "Ref"}}
MAPPINGS = {
    "signed.csv": json.dumps(SIGNED), "wrong.csv": json.dumps(SIGNED), "empty.csv": json.dumps(SIGNED), "indicator.csv": "{",
    "parts.csv": json.dumps({"layout": "indicator", "fields": {"date": "When", "merchant": "What", "amount": "Sum", "dc_indicator": "Type"}}),
    "split.csv": json.dumps({"layout": "split", "fields": {"date": "day", "merchant": "text", "debit": "out", "credit": "in"}}),
}


def test_layouts_broken_and_long_records(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_bytes(text.encode())
    records = folder.scan_folder(spark, str(tmp_path), spark.createDataFrame(list(MAPPINGS.items()), "file string, mapping string"))
    got = sorted((r.file, r.line, str(r.date), r.cents, r.imported_payee, r.imported_id) for r in folder.transactions(records).collect())
    assert got == [
        ("parts.csv", 2, "2025-03-01", -400, "Mill", None), ("parts.csv", 3, "2025-03-02", 100000, "Pay", None),
        ("signed.csv", 2, "2025-03-01", -1250, "Harbour, Books", "a1"), ("signed.csv", 3, "2025-03-02", 300, "Two\nlines", None), ("signed.csv", 7, "2025-03-05", 700, "Last", "a5"),
        ("split.csv", 2, "2025-03-01", -525, "Kiosk", None), ("split.csv", 3, "2025-03-02", 700, "Pay", None),
    ]
    bad = {(r.file, r.line): r.problem for r in folder.problems(records).collect()}
    assert {k[0] for k in bad if k[1] is None} == {"unmapped.csv", "wrong.csv", "indicator.csv"}  # Spark opens no file without bytes
    assert {k: v for k, v in bad.items() if k[1]} == {("signed.csv", 5): "3 fields, not 4", ("signed.csv", 6): "open quotes", ("signed.csv", 8): "no date", ("signed.csv", 9): "no amount", ("split.csv", 4): "no amount"}
    assert {r.file: (r.read, r.unread) for r in folder.counts(records).collect()} == {"signed.csv": (3, 4), "parts.csv": (2, 0), "split.csv": (2, 1), "unmapped.csv": (0, 1), "wrong.csv": (0, 1), "indicator.csv": (0, 1)}
