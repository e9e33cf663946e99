"""Batches of streams written to tables of numbered states, each exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources import tables


def exactly_once(spark: SparkSession, root: str, stream: str, change: Callable[[DataFrame, int | None], dict], tries: int = 5) -> Callable[[DataFrame, int], None]:
    """A writer for ``foreachBatch``. ``change``: (batch, number of the newest state) -> arguments of ``tables.commit``.

    The batch's number is part of the state that it makes, so that a batch that is run again changes nothing; where another writer
    touched the same keys, the change is computed anew.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        for left in reversed(range(tries)):
            base = tables.current(spark, root)
            if base and tables.state_of(spark, root, base).get("marks", {}).get(stream, -1) >= batch_id:
                return
            try:
                tables.commit(spark, root, base=base, mark=(stream, batch_id), **change(batch, base))
                return
            except tables.Conflict:
                if not left:
                    raise

    return write


def upserts(spark: SparkSession, root: str, stream: str, table: str, key: str) -> Callable[[DataFrame, int], None]:
    """Rows of a batch take the place of those with their keys."""
    return exactly_once(spark, root, stream, lambda batch, base: {"rows": {table: batch}, "touched": {table: batch.select(key)}, "key": key})


def bookkeeping(spark: SparkSession, root: str, stream: str = "results", seq: str = "seq") -> Callable[[DataFrame, int], None]:
    """Results of fetches (source_url, seq, at, status, reason, http_status) brought into the table ``sources``: as ``refresh.bookkeep``, one result after
    another by (at, seq). Sources that have no row are left out."""

    def change(batch: DataFrame, base: int | None) -> dict:
        sources = tables.read_table(spark, root, "sources", base)
        touched = sources.join(batch.select("source_url").distinct(), "source_url", "left_semi")
        return {"rows": {"sources": bookkeep_all(touched, batch, seq)}, "touched": {"sources": touched}}

    return exactly_once(spark, root, stream, change)


def bookkeep_all(sources: DataFrame, results: DataFrame, seq: str = "seq") -> DataFrame:
    """``sources`` after several results of each, in the order of (at, seq): what counts are the last result, the last that worked, and the
    failures since, so that no source's results are gathered."""
    good = F.col("status").isin("unchanged", "cosmetic", "meaningful")
    place = F.struct("at", seq)
    marked = results.withColumns({"__good": good, "__place": place})
    worked = marked.where("__good").groupBy("source_url").agg(F.max("__place").alias("__since"))
    since = marked.join(worked, "source_url", "left")
    after = F.col("__since").isNull() | (F.col("__place") > F.col("__since"))
    told = since.groupBy("source_url").agg(
        F.count_if(after & (F.col("status") == "fetch_failed")).alias("__fails"),
        F.max("__since").alias("__since"),
        F.max(F.when(F.col("__good"), F.col("at"))).alias("__worked"),
        F.max(F.when(F.col("status") == "meaningful", F.col("at"))).alias("__changed"),
        F.count_if(F.col("status") == "meaningful").alias("__changes"),
        F.max_by("status", "__place").alias("__status"),
        F.max_by("http_status", "__place").alias("__http"),
        F.max_by("reason", F.when(after & ~F.col("__good") & F.col("reason").isNotNull(), F.col("__place"))).alias("__reason"),
    )
    rows = sources.join(told, "source_url", "left")
    s, worked_once = F.col("__status"), F.col("__worked").isNotNull()
    last_good = s.isin("unchanged", "cosmetic", "meaningful")
    new = {
        "status": F.when(last_good, "ok").otherwise(F.coalesce(s, "status")),
        "consecutive_failures": F.when(worked_once, 0).otherwise(F.col("consecutive_failures")) + F.coalesce("__fails", F.lit(0)),
        "last_error": F.when(last_good, F.lit(None)).when(worked_once, F.col("__reason")).otherwise(F.coalesce("__reason", "last_error")),
        "last_http_status": F.when(s.isNull(), F.col("last_http_status")).when(s == "fetch_failed", F.col("__http")),
        "last_verified_at": F.coalesce("__worked", "last_verified_at"),
        "last_success_at": F.coalesce("__worked", "last_success_at"),
        "last_changed_at": F.coalesce("__changed", "last_changed_at"),
        "change_count": F.col("change_count") + F.coalesce("__changes", F.lit(0)),
    }
    kinds = dict(sources.dtypes)
    return rows.select(*(new[c].cast(kinds[c]).alias(c) if c in new else F.col(c) for c in sources.columns))
