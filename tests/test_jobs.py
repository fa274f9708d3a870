"""Corrections and the job chain on stored tables, with repeated deliveries."""

import datetime as dt
import json

import pytest

from ratewright.operators import persist
from ratewright.settings import Settings
from ratewright.streaming import corrections
from ratewright.streaming.engine import Engine, run_engine

DAY = dt.date(2025, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """The tables here are small, and each run is many plans."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_corrections_supersede_young_rows_only(spark, tmp_path):
    transactions, batches = persist.transactions_at(spark, str(tmp_path / "t"), 2), persist.batches_at(spark, str(tmp_path / "b"))
    inbox, checkpoint = tmp_path / "in", str(tmp_path / "ck")
    inbox.mkdir()

    def put(name, rows):
        (inbox / name).write_text("".join(json.dumps(dict(zip(("row", "account", "date", "cents", "merchant", "imported_id"), (r[0], 1, str(day(r[1])), *r[2:])))) + "\n" for r in rows))

    def run():
        stream = spark.readStream.schema(corrections.ROW).json(str(inbox))
        query = corrections.apply_corrections(stream, transactions, batches, checkpoint)
        query.awaitTermination()
        return sorted((r.id, r.cents) for r in transactions.read().collect())

    put("1.json", [(1, 0, -100, "Old", "a"), (2, 40, -200, "Young", "b"), (3, 41, -300, "Mill", None), (4, 41, -301, "Twice", "c"), (5, 41, -302, "Twice", "c")])
    assert run() == [(1, -100), (2, -200), (3, -300), (5, -302)]
    # a young row is replaced, an old one is not, a like one without an id is found by its name, a new one comes in
    put("2.json", [(11, 0, -111, "Old", "a"), (12, 40, -222, "Young", "b"), (13, 42, -300, "Mill", None), (14, 43, -400, "New", "d"), (15, 43, None, "Empty", "e")])
    want = [(1, -100), (5, -302), (12, -222), (13, -300), (14, -400)]
    assert run() == want
    counts = sorted(tuple(r) for r in batches.read().collect())
    assert counts[1][1:] == (3, 1, 2)
    version = transactions.manifest().version
    rows = spark.read.schema(corrections.ROW).json(str(inbox / "2.json"))
    corrections.correct(transactions, batches, rows, 1)  # delivered again
    assert run() == want and transactions.manifest().version == version and sorted(tuple(r) for r in batches.read().collect()) == counts


def month(k, d):
    return dt.date(2025, 1 + k, d)


STATEMENT = "Date,Payee,Amount,Ref\n" + "".join(f"{month(k, 5)},Lumen Power,-{40 + k}.00,p{k}\n{month(k, 7)},Salary Ridge,2000.00,s{k}\n" for k in range(5))
LATER = "When,What,Out,In\n" + "".join(f"{month(k, 5)},Lumen Power,{40 + k}.00,\n{month(k, 8)},Corner Grocer,{70 + 3 * k}.10,\n" for k in range(3, 7))
MAPPINGS = {"first.csv": {"layout": "signed", "fields": {"date": "Date", "merchant": "Payee", "amount": "Amount", "imported_id": "Ref"}}, "second.csv": {"layout": "split", "fields": {"date": "When", "merchant": "What", "debit": "Out", "credit": "In"}}}


def tables(engine):
    found = {"transactions": engine.transactions, "assignments": engine.assignments, "entries": engine.entries, "snapshots": engine.snapshots.snapshots, "projections": engine.projections, "jobs": engine.log}
    return {k: sorted(map(repr, t.read().collect())) for k, t in found.items()}


def test_statement_files_become_projections(spark, tmp_path):
    files, inbox = tmp_path / "files", tmp_path / "in"
    files.mkdir()
    inbox.mkdir()
    (files / "first.csv").write_text(STATEMENT)
    (files / "second.csv").write_text(LATER)
    accounts = spark.createDataFrame([(7, 1, 50_000), (8, 2, 0)], "account bigint, entity bigint, balance bigint")
    mappings = spark.createDataFrame([(k, json.dumps(v)) for k, v in MAPPINGS.items()], "file string, mapping string")
    engine = Engine(spark, str(tmp_path / "store"), accounts, mappings, Settings(window_days=30), 2)

    def message(name, job, path, entity="1"):
        (inbox / name).write_text(json.dumps({"job_id": job, "entity_id": entity, "job_type": "import.process", "metadata": json.dumps({"path": path and str(files / path), "account": 7 if path else None})}) + "\n")

    message("1.json", "j1", "first.csv")
    run_engine(engine, str(inbox), str(tmp_path / "ck")).awaitTermination()
    assert engine.transactions.read().count() == 10
    entries = {r.label: (r.direction, r.status) for r in engine.entries.read().collect()}
    assert entries == {"Lumen Power": ("spend", "pending"), "Salary Ridge": ("income", "pending")}
    once = tables(engine)
    assert len(once["projections"]) == 91 and len(once["snapshots"]) == 2 * sum((month(4, 7) - month(0, d)).days + 1 for d in (5, 7))

    message("2.json", "j2", "second.csv")
    message("3.json", "j3", None)
    (inbox / "4.json").write_text("not json\n")
    run_engine(engine, str(inbox), str(tmp_path / "ck")).awaitTermination()
    assert sorted((r.job_id, r.status) for r in engine.log.read().collect() if r.job_id.startswith("j")) == [("j1", "complete"), ("j2", "complete"), ("j3", "failed")] and engine.log.read().count() == 4
    # two of the later power bills were there already: they are skipped or replaced, not doubled
    assert sorted((r.date, r.cents) for r in engine.transactions.read().filter("merchant = 'Lumen Power'").collect()) == [(month(k, 5), -4000 - 100 * k) for k in range(7)]
    of = {r.entry: r.label for r in engine.entries.read().collect()}
    assert sorted(of[r.entry] for r in engine.assignments.read().collect()) == ["Corner Grocer"] * 4 + ["Lumen Power"] * 7 + ["Salary Ridge"] * 5
    assert {r.label for r in engine.entries.read().collect()} == {*entries, "Corner Grocer"}
    done = tables(engine)
    message("5.json", "j2", "second.csv")  # delivered again
    run_engine(engine, str(inbox), str(tmp_path / "ck")).awaitTermination()
    assert tables(engine) == done


@pytest.mark.parametrize("broken", ["save_projections"])
def test_a_batch_that_broke_off_is_delivered_again(spark, tmp_path, monkeypatch, broken):
    files = tmp_path / "first.csv"
    files.write_text(STATEMENT)
    accounts = spark.createDataFrame([(7, 1, 50_000)], "account bigint, entity bigint, balance bigint")
    mappings = spark.createDataFrame([("first.csv", json.dumps(MAPPINGS["first.csv"]))], "file string, mapping string")
    messages = spark.createDataFrame([("j1", "1", "import.process", json.dumps({"path": str(files), "account": 7}), "raw", True)], "job_id string, entity_id string, job_type string, metadata string, raw string, ok boolean")
    whole, halves = (Engine(spark, str(tmp_path / name), accounts, mappings, Settings(window_days=30), 2) for name in ("whole", "halves"))
    whole.handle(messages, 0)
    with monkeypatch.context() as m:
        m.setattr(persist, broken, lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            halves.handle(messages, 0)
    halves.handle(messages, 0)
    assert tables(halves) == tables(whole)
