"""Stored indexes of the test tables: built by the first query of an application that reads them, read by all others."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import text_index, vector_index
from siltstone.sources import scratch, tables

from .registry import table

#: Sources whose rows the second state replaces.
TOUCHED = ["src3", "src11"]


def root_of(spark: SparkSession, sf_dir: str, kind: str) -> str:
    return f"{scratch.folder(spark)}/{kind}-{hashlib.md5(sf_dir.encode()).hexdigest()[:12]}"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source_url, heading, content."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("source_url"), F.split("text", "\n")[0].alias("heading"), F.col("text").alias("content"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source_url, embedding: ten made sources."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 10).cast("string").alias("source_url"), "embedding")


def texts_of(spark: SparkSession, sf_dir: str, analyzer: str = "simple") -> str:
    """The root of the index of all chunks; its state 1 holds them as they are."""
    root = root_of(spark, sf_dir, f"texts-{analyzer}")
    if tables.current(spark, root) is None:
        text_index.build(spark, scratch.until_exit(spark, root), chunks(spark, sf_dir), analyzer)
    return root


def replaced_texts(spark: SparkSession, sf_dir: str) -> str:
    """The same with a state 2, in which of two sources the rows of even ids say all twice and the others are gone, and a state 3, in which all is
    merged."""
    root = texts_of(spark, sf_dir)
    if tables.current(spark, root) == 1:
        new = chunks(spark, sf_dir).where(F.col("source_url").isin(TOUCHED) & (F.col("id") % 2 == 0)).withColumn("content", F.concat("content", F.lit(" "), "content"))
        text_index.replace(spark, root, new, spark.createDataFrame([(s,) for s in TOUCHED], "source_url string"))
    if tables.current(spark, root) == 2:
        text_index.merge(spark, root)
    return root


def vectors_of(spark: SparkSession, sf_dir: str) -> str:
    root = root_of(spark, sf_dir, "vectors")
    if tables.current(spark, root) is None:
        vector_index.build(spark, scratch.until_exit(spark, root), vectors(spark, sf_dir))
    return root


def replaced_vectors(spark: SparkSession, sf_dir: str) -> str:
    """The same with a state 2, in which of one source the vectors of even ids are turned round and the others are gone."""
    root = vectors_of(spark, sf_dir)
    if tables.current(spark, root) == 1:
        new = vectors(spark, sf_dir).where("source_url = '4' AND id % 20 = 4").withColumn("embedding", F.transform("embedding", lambda x: -x))
        vector_index.replace(spark, root, new, spark.createDataFrame([("4",)], "source_url string"))
    return root
