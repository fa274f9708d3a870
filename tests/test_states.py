"""Keyed states and corrections of streams against their batch forms."""

import datetime as dt
import json
import random

from ratewright.streaming import state

DAY = dt.date(2025, 1, 1)
SCHEMA = "entry string, ts timestamp, cents long"


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("".join(json.dumps({"entry": e, "ts": f"{DAY + dt.timedelta(days=d)}T12:00:00Z", "cents": c}) + "\n" for e, d, c in rows))


def settled_by_force(batches, window, late, silence):
    """The rows of all batches, as the watermark after each of them lets them through."""
    days, out, mark, seen = {}, [], None, {}
    for rows in batches:
        taken = [r for r in rows if mark is None or r[1] + 0.5 >= mark]
        for e, d, c in taken:
            entry = days.setdefault(e, {})
            entry.setdefault(d, []).append(c)
        mark = max([r[1] + 0.5 - late for r in rows] + ([mark] if mark is not None else []))
        for e, entry in list(days.items()):
            for d in sorted(entry):
                if d + 1 <= mark and (e, d) not in seen:
                    seen[e, d] = True
                    held = [c for x, v in entry.items() if d - window <= x <= d for c in v]
                    out.append((e, DAY + dt.timedelta(days=d), "day", sum(held), len(held), DAY + dt.timedelta(days=min(entry))))
            if max(entry) + 1 + silence <= mark:
                out.append((e, DAY + dt.timedelta(days=max(entry)), "ended", 0, 0, DAY + dt.timedelta(days=min(entry))))
                del days[e]
    return sorted(out)


def test_states_of_entries_through_restarts(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.PROVIDER)
    rng = random.Random(3)
    inbox, checkpoint, found = tmp_path / "in", str(tmp_path / "ck"), str(tmp_path / "out")
    batches = []
    for k in range(6):  # days overlap from batch to batch, rows of a batch in any order, some too late
        low = k * 12
        batches.append([(rng.choice(["a", "b", "c"] if k < 3 else ["a", "b"]), max(0, low + rng.randrange(-9 if rng.random() < 0.9 else -40, 12)), rng.randrange(-900, 900)) for _ in range(40)])
    batches.append([("a", 200, 5)])
    for k, rows in enumerate(batches):
        put(inbox, f"{k:03d}", rows)
        stream = spark.readStream.schema(SCHEMA).json(str(inbox))
        rows = state.settled_days(stream, 7, "10 days", 30)
        # each file is a run of its own, from the checkpoint that the run before left
        query = rows.writeStream.format("parquet").option("path", found).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.exception() is None
    got = sorted(tuple(r) for r in spark.read.parquet(found).collect())
    want = settled_by_force(batches, 7, 10, 30)
    assert got == want and {"day", "ended"} == {r[2] for r in got}
