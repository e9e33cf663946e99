"""A refresh run over the tables of a corpus, in steps that are committed whole, so that a run that was killed goes on where it was."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources import scratch, tables

from . import ingest, refresh, text_index

#: Columns of sources that a run keeps, and of the chunks that it writes.
SOURCES = "source_url string, last_indexed_body string, status string, consecutive_failures int, last_error string, last_http_status int, last_verified_at timestamp, last_success_at timestamp, last_changed_at timestamp, change_count int"
CHUNKS = "id long, source_url string, section_heading string, heading_level int, content string"
#: A run's terminal rows; ``source`` is no key, so that they only grow.
RUNS = "run_id string, source string, status string, reason string, path string"


def begin(spark: SparkSession, root: str) -> int:
    """The first state: no sources, no chunks, no runs, an empty index."""
    empty = lambda schema: spark.createDataFrame([], schema)
    chunks = empty(CHUNKS)
    return tables.write_tables(spark, root, {"sources": empty(SOURCES), "chunks": chunks, "runs": empty(RUNS), "postings": _postings(chunks), "about": text_index.about(spark)}, "source_url", text_index.BY)


def _postings(chunks: DataFrame) -> DataFrame:
    return text_index.postings(chunks.select("id", "source_url", F.col("section_heading").alias("heading"), "content"))


def pending(spark: SparkSession, root: str, run_id: str, manifest: DataFrame, number: int | None = None) -> DataFrame:
    """Sources of the manifest that the run has no terminal row of."""
    runs = tables.read_table(spark, root, "runs", number).withColumnRenamed("source", "source_url")
    return refresh.pending(manifest.select("source_url").distinct(), runs, run_id)


def step(spark: SparkSession, root: str, run_id: str, manifest: DataFrame, fetch: Callable[[DataFrame], DataFrame], verdict: Column, now: Column, most: int) -> int:
    """How many sources were fetched: up to ``most`` that are pending, by name. ``fetch``: (source_url) -> (source_url, outcome, body, http_status).

    Their rows, those of the run, their chunks and postings, where they were indexed anew, are one commit.
    """
    base = tables.current(spark, root)
    todo = scratch.written(pending(spark, root, run_id, manifest, base).orderBy("source_url").limit(most), "todo")
    n = todo.count()
    if not n:
        return 0
    got = scratch.written(fetch(todo).select("source_url", "outcome", "body", "http_status"), "fetched")
    held = tables.read_tables(spark, root, ["sources", "chunks"], base)
    results = scratch.written(refresh.route_sources(got, held["sources"].select("source_url", "last_indexed_body"), held["chunks"], verdict).join(got.select("source_url", "http_status"), "source_url"), "results")

    known = held["sources"].join(todo, "source_url", "left_semi")
    fresh = todo.join(known, "source_url", "left_anti").select("source_url", *(F.lit(0).cast("int").alias(c.split()[0]) if c.split()[0] in ("consecutive_failures", "change_count") else F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in SOURCES.split(", ")[1:]))
    after = refresh.bookkeep(known.unionByName(fresh), results, now)
    indexed = got.join(results.where("path = 'reindex'").select("source_url"), "source_url", "left_semi").select("source_url", "body")
    rows = after.join(indexed, "source_url", "left").withColumn("last_indexed_body", F.coalesce("body", "last_indexed_body")).select(*known.columns)
    chunks = scratch.written(ingest.chunks_of(indexed).select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in CHUNKS.split(", "))), "chunks")
    told = results.select(F.lit(run_id).alias("run_id"), F.col("source_url").alias("source"), "status", "reason", "path")
    tables.commit(spark, root, {"sources": rows, "chunks": chunks, "postings": _postings(chunks), "runs": told}, {"sources": todo, "chunks": indexed, "postings": indexed}, base=base, by=text_index.BY)
    return n


def run(spark: SparkSession, root: str, run_id: str, manifest: DataFrame, fetch: Callable[[DataFrame], DataFrame], verdict: Column, now: Column, most: int = 10_000) -> DataFrame:
    """run_id, source, status, reason, path of all sources, those of earlier steps of the run among them."""
    while step(spark, root, run_id, manifest, fetch, verdict, now, most):
        pass
    return tables.read_table(spark, root, "runs").where(F.col("run_id") == run_id)
