"""The token bucket on a stream: state by key, one row out for each request."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.operators.buckets import Bucket


def stream_token_bucket(requests: DataFrame, key: str, micros: str, order: str, capacity: float = 20.0, per_second: float = 1.0, late: str = "10 minutes") -> DataFrame:
    """key, order, allowed, retry_after of a stream of (key long, micros long, order long); within a micro-batch requests
    go by (micros, order), and time that runs back gains nothing.

    All time is the requests', and the watermark is ``late`` behind the newest; a request behind it is left out. State goes when the watermark has passed the moment
    at which the bucket is full again, as a new bucket is full too.
    """
    full = int(capacity / per_second * 1000) + 60_000

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        bucket = Bucket(capacity, per_second, *(state.get if state.exists else (None, None)))
        rows = pd.concat(list(frames)).sort_values([micros, order])
        taken = [bucket.take(t) for t in rows[micros]]
        state.update((float(bucket.level), int(bucket.last)))
        state.setTimeoutTimestamp(max(int(bucket.last) // 1000 + full, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: k[0], order: rows[order], "allowed": [a for a, _ in taken], "retry_after": [w for _, w in taken]})

    schema = f"{key} long, {order} long, allowed boolean, retry_after long"
    timed = requests.withColumn("__at", F.timestamp_micros(micros)).withWatermark("__at", late)
    return timed.groupBy(key).applyInPandasWithState(run, schema, "level double, last long", "append", GroupStateTimeout.EventTimeTimeout)
