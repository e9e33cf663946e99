"""Snapshots of pages: text files with YAML between lines of three hyphens, then Markdown."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from siltstone.functions.text import snapshot_name

#: Keys that a crawl computes, in the order in which they are written; all others are a curator's and are kept.
BASE = ["source_url", "resolved_url", "title", "fetched_at", "page_last_updated", "topic"]
BLOCK = r"(?s)\A---\s*\n(.*?\n)---\s*\n?"


@F.pandas_udf(MapType(StringType(), StringType()))
def yaml_fields(block: pd.Series) -> pd.Series:
    """Fields of a YAML block as text; null for what isn't one, dates that there aren't among them."""
    import yaml

    def one(raw):
        try:
            fields = yaml.safe_load(raw)
        except (yaml.YAMLError, ValueError, TypeError, RecursionError):  # its constructors raise what Python's types do
            return None
        return {str(k): None if v is None else str(v) for k, v in fields.items()} if isinstance(fields, dict) else None

    return block.map(one, na_action="ignore")


def parse(raw: Column) -> tuple[Column, Column]:
    """(block of fields or null, body) of a snapshot's text."""
    return F.nullif(F.regexp_extract(raw, BLOCK, 1), F.lit("")), F.regexp_replace(raw, BLOCK, "")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """path, source_url, fields, body of each file; fields of a damaged block are null."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    block, body = parse(F.col("value"))
    rows = files.select("path", yaml_fields(block).alias("fields"), body.alias("body"))
    return rows.select("path", F.col("fields")["source_url"].alias("source_url"), "fields", "body")


def index(snapshots: DataFrame) -> DataFrame:
    """source_url, path: the last file of each source by name; those without a source are left out."""
    return snapshots.where(F.coalesce("source_url", F.lit("")) != "").groupBy("source_url").agg(F.max("path").alias("path"))


def merge_fields(existing: Column, computed: Column) -> Column:
    """Computed values of the base keys, without nulls, and all other keys of ``existing`` as they are."""
    base = [F.struct(F.lit(k).alias("key"), computed[k].alias("value")) for k in BASE]
    fresh = F.filter(F.array(*base), lambda e: e["value"].isNotNull())
    kept = F.filter(F.map_entries(existing), lambda e: ~e["key"].isin(BASE))
    return F.map_from_entries(F.concat(fresh, F.coalesce(kept, F.array().cast("array<struct<key:string,value:string>>"))))


def render(fields: Column, body: Column) -> Column:
    """A snapshot's text; values are quoted as JSON strings, which YAML reads."""
    lines = F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(F.regexp_extract(F.to_json(F.struct(e["value"].alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit("null"))))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n\n"), F.regexp_replace(body, r"\A\n+", ""))


def write_snapshots(pages: DataFrame, path: str) -> None:
    """A folder ``name=<topic-host-page.md>`` with one text file for each page (topic, source_url, fields, body)."""
    rows = pages.select(snapshot_name(F.col("topic"), F.col("source_url")).alias("name"), render(F.col("fields"), F.col("body")).alias("value"))
    rows.write.mode("overwrite").option("lineSep", "\u0000").partitionBy("name").text(path)
