"""Traces of requests, assembled from their stage events.

Events (request_id, at, seq, event, detail) of one id that are no more than a timeout apart are one request. Its first result or error
ends it, and events after that are ignored; without either it is incomplete. A stage lasts until the next event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TERMINAL = ("result", "error")


def traces(events: DataFrame, timeout_seconds: float) -> DataFrame:
    """request_id, started, ended, outcome (result, error or incomplete), detail (of the outcome), events, stages: (stage, micros) by first
    occurrence, without time for a stage that nothing follows. Events without a request or a time are left out."""
    order = W.partitionBy("request_id").orderBy("at", "seq")
    rows = events.where("request_id IS NOT NULL AND at IS NOT NULL").withColumn("__us", F.unix_micros(F.col("at").cast("timestamp")))
    gap = F.coalesce(F.col("__us") - F.lag("__us").over(order) > int(timeout_seconds * 1e6), F.lit(False))
    rows = rows.withColumn("__gap", gap.cast("int")).withColumn("nth", F.sum("__gap").over(order.rowsBetween(W.unboundedPreceding, 0)))
    own = W.partitionBy("request_id", "nth").orderBy("at", "seq")
    ends = F.col("event").isin(*TERMINAL)
    before = F.sum(ends.cast("int")).over(own.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("__over", F.coalesce(before, F.lit(0)) > 0).where("NOT __over")
    rows = rows.withColumns({"__place": F.row_number().over(own), "__micros": F.lead("__us").over(own) - F.col("__us")})
    by = ["request_id", "nth"]
    whole = rows.groupBy(*by).agg(
        F.min("at").alias("started"), F.max("at").alias("ended"), F.count("*").alias("events"), F.max(F.when(ends, F.struct("event", "detail"))).alias("__end")
    )
    stages = rows.where(~ends).groupBy(*by, "event").agg(F.min("__place").alias("place"), F.sum("__micros").alias("micros"))
    stages = stages.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", F.col("event").alias("stage"), "micros"))).alias("__stages"))
    out = whole.join(stages, by, "left")
    listed = F.transform(F.coalesce("__stages", F.array().cast("array<struct<place:int,stage:string,micros:bigint>>")), lambda s: F.struct(s["stage"].alias("stage"), s["micros"].alias("micros")))
    return out.select("request_id", "started", "ended", F.coalesce("__end.event", F.lit("incomplete")).alias("outcome"), F.col("__end.detail").alias("detail"), "events", listed.alias("stages"))
