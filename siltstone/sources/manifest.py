"""The list of sources that a curator keeps, in YAML: url, title, topic, and annotations by name."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "source_url string, title string, topic string, annotations map<string,string>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row for each entry of ``sources``, in the file's order of files; annotations as text. A missing annotation and one that is null are the same."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for frame in frames:
            rows = []
            for raw in frame["value"]:
                for e in yaml.safe_load(raw)["sources"]:
                    notes = {k: v if isinstance(v, str) else json.dumps(v, default=str).strip('"') for k, v in (e.get("annotations") or {}).items() if v is not None}
                    rows.append((e["url"], e.get("title"), e.get("topic"), notes))
            yield pd.DataFrame(rows, columns=["source_url", "title", "topic", "annotations"])

    return spark.read.text(path, wholetext=True).mapInPandas(parse, SCHEMA)


def annotations(manifest: DataFrame) -> DataFrame:
    """source_url and the four annotations of a rule by type. ``rule_status_source_evidences_status`` stays text, so that what isn't a boolean can be refused."""
    of = lambda k: F.col("annotations")[k]
    return manifest.select("source_url", F.try_to_date(of("rule_effective_date"), "yyyy-MM-dd").alias("rule_effective_date"), of("rule_status").alias("rule_status"), of("rule_status_source").alias("rule_status_source"), of("rule_status_source_evidences_status").alias("rule_status_source_evidences_status"))


def only(manifest: DataFrame, urls: list[str] | None) -> DataFrame:
    """The entries that are named, or all."""
    return manifest.where(F.col("source_url").isin(urls)) if urls else manifest


def contactable(agent: Column) -> Column:
    """Whether a crawler's name holds an address at which somebody can be reached."""
    domain = F.lower(F.regexp_extract(agent, r"[^\s@]+@((?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})", 1))
    return ~F.contains(agent, F.lit("set-a-real-contact-here")) & (domain != "") & ~domain.isin("example.com", "example.org", "example.net")
