"""Tables that a job writes for itself, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset there must be no cluster, and a local session gets a folder under /tmp."""
    if shared := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return f"{shared}/siltstone-{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file:///tmp/siltstone-scratch/{spark.sparkContext.applicationId}"


def until_exit(spark: SparkSession, path: str) -> str:
    """``path``, which goes when the application ends."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back, so that its lineage ends there and a lost executor costs none of its work again."""
    spark = df.sparkSession
    path = until_exit(spark, f"{folder(spark)}/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
