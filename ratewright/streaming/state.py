"""State per entry in a stream: rolling totals of settled days, and entries that fall silent.

A day of an entry is settled when the watermark has passed it; until then rows come in any
order. The state of an entry is the sums of its days within the window or not settled yet,
and one row about the entry itself, so it does not grow with the stream. Timers fire when
the next day settles and when an entry has been silent for too long; then its state goes.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a stream of states gives: a row per settled day with transactions, and one when the entry ends.
OUT = "entry string, date date, kind string, total bigint, count bigint, first_date date"
#: The state store that keyed states with timers need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_DAY_MS = 86_400_000


def _date(day: int) -> dt.date:
    return dt.date(1970, 1, 1) + dt.timedelta(days=day)


class EntryStates(StatefulProcessor):
    """``days``: sums by day number. ``facts``: first day, last day seen, last day settled (-1 is none)."""

    def __init__(self, window: int, silence: int):
        self.window, self.silence = window, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day int", "cents bigint, n bigint")
        self.facts = handle.getValueState("facts", "first int, last int, settled int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, last, settled = self.facts.get() if self.facts.exists() else (None, None, -1)
        for part in rows:
            for day, group in part.groupby("day")["cents"]:
                day = int(day)
                cents, n = self.days.getValue((day,)) if self.days.containsKey((day,)) else (0, 0)
                self.days.updateValue((day,), (int(cents) + int(group.sum()), int(n) + len(group)))
                first = day if first is None else min(first, day)
                last = day if last is None else max(last, day)
        self.facts.update((first, last, settled))
        self._set_timers(last)
        return iter(())

    def _set_timers(self, last: int) -> None:
        """One timer for the next day to settle, one for silence; both at the first moment after the day."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        open_ = [k[0] for k in self.days.keys() if k[0] > self.facts.get()[2]]
        if open_:
            self.handle.registerTimer((min(open_) + 1) * _DAY_MS)
        self.handle.registerTimer((last + 1 + self.silence) * _DAY_MS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.facts.exists():
            return  # another timer of this batch ended the entry
        first, last, settled = self.facts.get()
        upto = timerValues.getCurrentWatermarkInMs() // _DAY_MS - 1
        sums = {k[0]: v for k, v in self.days.iterator()}
        out = []
        for day in sorted(d for d in sums if settled < d <= upto):
            held = [sums[d] for d in sums if day - self.window <= d <= day]
            out.append((key[0], _date(day), "day", sum(int(c) for c, _ in held), sum(int(n) for _, n in held), _date(first)))
            settled = day
        if upto >= last + self.silence:
            out.append((key[0], _date(last), "ended", 0, 0, _date(first)))
            self.facts.clear()
            self.days.clear()
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
        else:
            # days that no later window reaches
            for day in [d for d in sums if d < settled - self.window]:
                self.days.removeKey((day,))
            self.facts.update((first, last, settled))
            self._set_timers(last)
        if out:
            yield pd.DataFrame(out, columns=["entry", "date", "kind", "total", "count", "first_date"])

    def close(self) -> None:
        pass


def settled_days(stream: DataFrame, window: int, late: str = "14 days", silence: int = 365) -> DataFrame:
    """Rolling totals of ``stream(entry, ts, cents)`` by entry and settled day, both ends of the window included.

    Each day with transactions gives one ``day`` row once it is ``late`` behind the newest row,
    with all that came in before then, in whatever order; rows that come later are dropped, as
    :func:`.corrections.apply_corrections` is for those. An entry without a row for ``silence``
    days gives an ``ended`` row with its last day and is forgotten: a later row begins it anew.
    Rows without an entry, time or amount are left out.
    """
    rows = stream.filter("entry is not null and ts is not null and cents is not null").withWatermark("ts", late)
    rows = rows.select("entry", "ts", F.unix_date(F.to_date("ts")).alias("day"), F.col("cents").cast("bigint").alias("cents"))
    return rows.groupBy("entry").transformWithStateInPandas(EntryStates(window, silence), OUT, "append", "eventTime")
