"""Traces of requests on a stream: a request's events are held until the watermark has passed its timeout."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.operators.traces import TERMINAL

SCHEMA = "request_id string, started timestamp, ended timestamp, outcome string, detail string, events long, stages array<struct<stage:string,micros:long>>"


def trace_of(events: list[tuple]) -> tuple:
    """started, ended (micros), outcome, detail, events, stages of one request's (micros, seq, event, detail), in their order."""
    end = next((i for i, e in enumerate(events) if e[2] in TERMINAL), None)
    kept = events if end is None else events[: end + 1]
    stages: dict[str, int | None] = {}
    for e, after in zip(kept, [*kept[1:], None]):
        if e[2] not in TERMINAL:
            micros = None if after is None else after[0] - e[0]
            held = stages.get(e[2])
            stages[e[2]] = held if micros is None else micros + (held or 0)
    outcome, detail = ("incomplete", None) if end is None else events[end][2:]
    return kept[0][0], kept[-1][0], outcome, detail, len(kept), [{"stage": k, "micros": v} for k, v in stages.items()]


def stream_traces(events: DataFrame, timeout_seconds: float, late: str = "10 minutes") -> DataFrame:
    """What ``operators.traces.traces`` gives, of a stream of (request_id, at, seq, event, detail). A row comes out once the watermark, which is ``late``
    behind the newest event, has passed the request's timeout; an event behind the watermark is left out."""
    wait = int(timeout_seconds * 1e6)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [tuple(e) for e in zip(*state.get)] if state.exists else []
        if not state.hasTimedOut:
            for f in frames:
                held += list(zip(f["micros"].tolist(), f["seq"].tolist(), f["event"].tolist(), f["detail"].tolist()))
        held.sort(key=lambda e: e[:2])
        requests: list[list] = []
        for e in held:
            if not requests or e[0] - requests[-1][-1][0] > wait:
                requests.append([])
            requests[-1].append(e)
        passed = state.getCurrentWatermarkMs() * 1000
        over = [r for r in requests if r[-1][0] + wait < passed]
        rest = [e for r in requests[len(over) :] for e in r]
        if rest:
            state.update(tuple(list(c) for c in zip(*rest)))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), (requests[len(over)][-1][0] + wait) // 1000) + 1)
        elif state.exists:
            state.remove()
        if over:
            rows = [(key[0], *trace_of(r)) for r in over]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            for c in ("started", "ended"):
                out[c] = pd.to_datetime(out[c], unit="us", utc=True).dt.tz_localize(None)
            yield out

    timed = events.where("request_id IS NOT NULL AND at IS NOT NULL").withColumn("micros", F.unix_micros(F.col("at").cast("timestamp"))).withWatermark("at", late)
    told = timed.select(F.col("request_id").cast("string").alias("request_id"), "at", "micros", F.col("seq").cast("long").alias("seq"), "event", "detail")
    return told.groupBy("request_id").applyInPandasWithState(run, SCHEMA, "micros array<long>, seq array<long>, event array<string>, detail array<string>", "append", GroupStateTimeout.EventTimeTimeout)
