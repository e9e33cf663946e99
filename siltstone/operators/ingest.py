"""From pages and snapshots to a corpus of chunks: each source's chunks are replaced as a whole, with its row of bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siltstone.functions import html as ht
from siltstone.functions.isolate import isolated

from .ledger import sections

ANNOTATIONS = ["rule_effective_date", "rule_status", "rule_status_source", "rule_status_source_evidences_status"]


def chunks_of(bodies: DataFrame) -> DataFrame:
    """id, source_url, section_heading, heading_level, content of (source_url, body) in Markdown; ids are hashes of the source and the line."""
    found = sections(bodies.select("source_url", "body"), "source_url", "body")
    return found.select(F.xxhash64("source_url", "line").alias("id"), "source_url", F.col("heading").alias("section_heading"), F.col("level").alias("heading_level"), F.concat("breadcrumb", F.lit("\n\n"), "chunk").alias("content"))


def bodies_of(pages: DataFrame) -> DataFrame:
    """source_url, title, page_last_updated, body, error of pages (url, html); one without a title keeps its address, and one that can't be
    read has an error and no body."""
    told = pages.withColumn("__told", F.when(F.col("html").isNotNull(), isolated(ht.page_markdown, StringType())("html")))
    return told.select(
        F.col("url").alias("source_url"),
        F.coalesce(ht.title(F.col("html")), F.col("url")).alias("title"),
        ht.last_updated(ht.page_text(F.col("html"))).alias("page_last_updated"),
        F.col("__told.value").alias("body"),
        F.col("__told.error").alias("error"),
    )


def reindex(sources: DataFrame, chunks: DataFrame, bodies: DataFrame, annotations: DataFrame, embed, now: Column) -> tuple[DataFrame, DataFrame]:
    """(sources, chunks) after the given bodies were indexed; write both at once (``siltstone.sources.tables``).

    A source's chunks all give way to the new ones, with the annotations of its entry; its row gets the body and the moment, and counts a change if it was
    there. Other sources stay as they are. ``embed``: column function text -> vector.
    """
    new = chunks_of(bodies).withColumn("embedding", embed("content")).join(annotations.select("source_url", *ANNOTATIONS), "source_url", "left").select(chunks.columns)
    kept = chunks.join(bodies.select("source_url"), "source_url", "left_anti").select(chunks.columns)
    # told before the join, so that bodies move only for who reads them
    rows = sources.join(bodies.select("source_url", F.col("body").alias("__body"), F.col("body").isNotNull().alias("__there")), "source_url", "full_outer")
    there = F.coalesce("__there", F.lit(False))
    out = rows.select(
        "source_url",
        F.coalesce("__body", "last_indexed_body").alias("last_indexed_body"),
        F.when(there, now).otherwise(F.col("fetched_at")).alias("fetched_at"),
        F.when(there, now).otherwise(F.col("last_changed_at")).alias("last_changed_at"),
        (F.coalesce("change_count", F.lit(0)) + F.when(there & F.col("change_count").isNotNull(), 1).otherwise(0)).alias("change_count"),
    )
    return out, kept.unionByName(new)


def orphans(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks whose source has no row: none, in a corpus that is whole."""
    return chunks.join(sources.select("source_url"), "source_url", "left_anti")
