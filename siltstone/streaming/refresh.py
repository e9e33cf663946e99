"""A refresh on a stream: which sources to fetch, when to try again, and what their last attempt gave, in state by source.

What comes in are events of a source: ``start``, or the outcome of an attempt. What goes out are requests to fetch, with the moment
at which they are due, and a settled row for each source, after which its events are ignored. The state outlives the query, so that one
which is stopped goes on from there and asks for no source again.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

ENDS = ("ok", "robots")
OUT = "source_url string, kind string, attempts int, outcome string, body string, http_status int, due timestamp"
STATE = StructType([StructField("attempts", IntegerType()), StructField("done", BooleanType()), StructField("due", LongType())])
COLUMNS = [c.split()[0] for c in OUT.split(", ")]


class Fetches(StatefulProcessor):
    """``most`` attempts; the n-th one after a failure is due factor^n seconds later, ``cap`` at most; one without an outcome for ``patience`` seconds is a
    timeout."""

    def __init__(self, most: int = 3, factor: float = 1.5, cap: float = 60.0, patience: float = 120.0):
        self.most, self.factor, self.cap, self.patience = most, factor, cap, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("source", STATE)

    def close(self) -> None:
        pass

    def _ask(self, source: str, attempts: int, due: int) -> tuple:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(due + int(self.patience * 1000))
        self.state.update((attempts, False, due))
        return source, "fetch", attempts + 1, None, None, None, due

    def _tried(self, source: str, at: int, outcome: str, body: str | None, http_status: int | None) -> tuple:
        attempts = self.state.get()[0] + 1
        if outcome in ENDS or attempts >= self.most:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.state.update((attempts, True, 0))
            return source, "settled", attempts, outcome, body, http_status, None
        return self._ask(source, attempts, at + int(1000 * min(self.factor**attempts, self.cap)))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ms", "attempt"])  # a source's events of one batch: a few attempts
        out = []
        for e in events.itertuples():
            if e.outcome == "start":
                if not self.state.exists():
                    out.append(self._ask(key[0], 0, int(e.ms)))
            elif self.state.exists():
                attempts, done, _ = self.state.get()
                if not done and e.attempt == attempts + 1:  # an outcome that came before, or late, changes nothing
                    out.append(self._tried(key[0], int(e.ms), e.outcome, e.body, None if pd.isna(e.http_status) else int(e.http_status)))
        if out:
            yield told(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.state.exists() and not self.state.get()[1]:
            yield told([self._tried(key[0], expiredTimerInfo.getExpiryTimeInMs(), "timeout", None, None)])


def told(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=COLUMNS)
    out["due"] = pd.to_datetime(out["due"], unit="ms")
    out["http_status"] = out["http_status"].astype("Int32")
    return out


def stream_fetches(events: DataFrame, late: str = "10 minutes", **limits) -> DataFrame:
    """OUT of a stream of events (source_url, at, attempt, outcome, body, http_status), in which ``start`` is attempt 0. All time is the events': timers
    go off when the watermark, which is ``late`` behind the newest, has passed them."""
    timed = events.withWatermark("at", late).withColumn("ms", F.unix_millis(F.col("at").cast("timestamp")))
    return timed.groupBy("source_url").transformWithStateInPandas(statefulProcessor=Fetches(**limits), outputStructType=OUT, outputMode="append", timeMode="eventTime", eventTimeColumnName="")
