"""What a crawl may fetch, and what tables there are."""

from __future__ import annotations

from functools import lru_cache
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^([a-z]+://[^/?#]+)", 1)


@lru_cache(maxsize=256)
def robots_rules(text: str) -> RobotFileParser:
    parser = RobotFileParser()
    parser.parse(text.splitlines())
    return parser


def robots_gate(pages: DataFrame, robots: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """Every page with ``allowed``. ``robots``: (host, status_code, text) of each host's robots.txt; a host without one, or with one that couldn't be
    read, allows all. An address that can't be read is not allowed where there are rules."""

    def one(text: str | None, address: str | None) -> bool:
        try:
            return text is None or bool(robots_rules(text).can_fetch(agent, address))
        except ValueError:
            return False

    @F.pandas_udf(BooleanType())
    def may(text: pd.Series, address: pd.Series) -> pd.Series:
        return pd.Series([one(t, u) for t, u in zip(text, address)])

    known = robots.where("status_code < 400").groupBy("host").agg(F.max("text").alias("__robots"))
    return pages.withColumn("__host", host(F.col(url))).join(known.withColumnRenamed("host", "__host"), "__host", "left").withColumn("allowed", may("__robots", url)).drop("__host", "__robots")


def catalog(spark: SparkSession, tables: dict[str, DataFrame], defaults: dict[str, set[str]] | None = None) -> DataFrame:
    """table_name, column_name, data_type, nullable, has_default of the given tables."""
    rows = [(t, f.name, f.dataType.simpleString(), f.nullable, f.name in (defaults or {}).get(t, set())) for t, df in tables.items() for f in df.schema.fields]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, nullable boolean, has_default boolean")
