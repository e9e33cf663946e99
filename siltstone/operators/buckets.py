"""Keyed token buckets in batch, with the same rule for streams in siltstone.streaming."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Bucket:
    """A bucket begins full, gains ``per_second`` tokens up to ``capacity`` (none for time that runs back), and a request
    takes one if there is one; else it may come again after so many whole seconds."""

    def __init__(self, capacity: float, per_second: float, level: float | None = None, last: float | None = None):
        self.capacity, self.per_second = capacity, per_second
        self.level, self.last = capacity if level is None else level, last

    def take(self, micros: float) -> tuple[bool, int]:
        before = micros if self.last is None else self.last
        self.level = min(self.capacity, self.level + max(0.0, (micros - before) / 1e6) * self.per_second)
        self.last = max(micros, before)
        if self.level >= 1:
            self.level -= 1
            return True, 0
        return False, math.floor((1 - self.level) / self.per_second) + 1


def token_bucket(requests: DataFrame, key: str, micros: Column, order: str, capacity: float = 20.0, per_second: float = 1.0) -> DataFrame:
    """key, order, allowed, retry_after for each request in the order of (micros, order).

    Requests are dealt out by key and come to a task in their order; it keeps two numbers for the key at hand, however many requests that has.
    A null key is a key of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, bucket = object(), None
        for batch in batches:
            allowed, wait = [], []
            for k, t in zip(batch.column("k").to_pylist(), batch.column("t").to_pylist()):
                if bucket is None or k != current:
                    current, bucket = k, Bucket(capacity, per_second)
                ok, seconds = bucket.take(t)
                allowed.append(ok)
                wait.append(seconds)
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("o"), pa.array(allowed, pa.bool_()), pa.array(wait, pa.int64())], ["k", "o", "allowed", "retry_after"])

    rows = requests.select(F.col(key).alias("k"), micros.cast("double").alias("t"), F.col(order).alias("o"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("k", "o"))
    dealt = rows.repartition("k").sortWithinPartitions("k", "t", "o")
    return dealt.mapInArrow(run, f"{kinds}, allowed boolean, retry_after long").withColumnsRenamed({"k": key, "o": order})
