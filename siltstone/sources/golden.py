"""Golden questions, baselines and results of evaluations, as JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "question string, ground_truth_answer string, source_urls array<string>, is_advice boolean, verified_on date, volatility string, multi_part boolean"
FIELDS = ["question", "ground_truth_answer", "source_urls", "is_advice", "verified_on", "volatility", "multi_part"]


def read_golden(spark: SparkSession, path: str, rows: int) -> DataFrame:
    """The golden rows; anything that isn't JSON, lacks a field, or isn't exactly ``rows`` rows is an error."""
    golden = spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path)
    lacking = None
    for f in FIELDS:
        lacking = F.col(f).isNull() if lacking is None else lacking | F.col(f).isNull()
    n, bad = golden.agg(F.count("*"), F.count_if(lacking)).first()
    if bad or n != rows:
        raise ValueError(f"{n} golden rows, {bad} of them without a required field; {rows} whole ones expected")
    return golden


def golden_urls(spark: SparkSession, path: str) -> DataFrame | None:
    """row, source_urls of each golden row, blank lines not counted; None, which is unknown and not none, if the file is missing or any line has a defect."""
    from pyspark.errors import AnalysisException

    try:
        lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), F.trim("value").alias("value"))
    except AnalysisException:
        return None
    parsed = lines.where("value <> ''").withColumn("urls", F.from_json(F.variant_get(F.try_parse_json("value"), "$.source_urls", "string"), "array<string>"))
    parsed = parsed.withColumn("list", F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), "$.source_urls", "variant")).startswith("ARRAY"))
    if parsed.where("not coalesce(list, false)").limit(1).count():
        return None
    from pyspark.sql import Window as W

    return parsed.select((F.row_number().over(W.orderBy("file", "at", "id")) - 1).alias("row"), F.col("urls").alias("source_urls"))  # a file of some dozen rows


def read_baselines(spark: SparkSession, path: str) -> DataFrame:
    """metric, value of the baseline file's ``metrics``."""
    metrics = spark.read.schema("metrics map<string,double>").json(path, multiLine=True)
    return metrics.select(F.explode("metrics").alias("metric", "value"))


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)
