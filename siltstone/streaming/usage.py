"""Usage counters on streams: totals, sessions first seen, and a day's cap that is decided in the order of time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def once(events: DataFrame, key: str, at: str, late: str = "10 minutes") -> DataFrame:
    """Events of a stream without those whose key came before, if no more than ``late`` apart."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, session: Column, at: str) -> DataFrame:
    """session, n, first_seen: exact, in state by session; events without a session count for none. For output mode update or complete."""
    return events.withColumn("session", session).where("session IS NOT NULL").groupBy("session").agg(F.count("*").alias("n"), F.min(at).alias("first_seen"))


def totals(events: DataFrame, day: Column) -> DataFrame:
    """day, n: running totals, for output mode update or complete; the sum over all days is the total."""
    return events.groupBy(day.alias("day")).agg(F.count("*").alias("n"))


def capped(calls: DataFrame, key: str, at: str, cap: int, late: str = "10 minutes") -> DataFrame:
    """key, over_budget of a stream of calls: over it are all of a UTC day but its first ``cap`` by (time, key).

    A call is held until the watermark, which is ``late`` behind the newest, has passed it; so calls that come late, but not behind the
    watermark, are decided in their order. A day's state is a count and the calls that are held; it goes when the day is over. A cap of nought
    or less is off.
    """

    def run(day: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, *held = state.get if state.exists else (0, [], [])
        waiting = list(zip(*held))
        if not state.hasTimedOut:
            for f in frames:
                waiting += list(zip(f["micros"].tolist(), f[key].tolist()))
        waiting.sort()
        passed = state.getCurrentWatermarkMs()
        ready = [w for w in waiting if w[0] // 1000 < passed]
        rest = waiting[len(ready) :]
        out = pd.DataFrame({key: [k for _, k in ready], "over_budget": [cap > 0 and n + i >= cap for i in range(len(ready))]})
        n += len(ready)
        ends = (day[0] + 1) * 86_400_000
        if rest or ends > passed:
            state.update((n, [t for t, _ in rest], [k for _, k in rest]))
            state.setTimeoutTimestamp(max(passed, rest[0][0] // 1000 if rest else ends) + 1)
        elif state.exists:
            state.remove()
        if len(out):
            yield out

    kind = calls.schema[key].dataType.simpleString()
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    timed = calls.withWatermark(at, late).select(F.col(key), at, micros.alias("micros"), F.floor(micros / 86_400_000_000).cast("long").alias("__day"))
    return timed.groupBy("__day").applyInPandasWithState(run, f"{key} {kind}, over_budget boolean", f"n long, at array<long>, keys array<{kind}>", "append", GroupStateTimeout.EventTimeTimeout)
