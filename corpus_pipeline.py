"""A corpus pipeline of this library's training-data operators, over the table ``documents``.

Each stage takes all rows that the one before kept, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import lang_id, line_dedup, mixing, order_minhash, packing
from siltstone.llm.common import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Sureness of each of the two steps of a prediction below which another class won in some pair.
SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; ``lang`` becomes the language told. Texts that are null or without a letter go, and
    those for which no family or no language wins against all others; all texts go where no row bears a language. Null ids
    and sources, repeated rows and other columns change nothing."""
    found = lang_id.identify(docs).where((F.col("lang_pred") != lang_id.UNKNOWN) & (F.col("sure") >= SURE))
    return found.withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs of lines; documents of which no word is left go, those that had none stay. A null
    text stays null; of repeated rows of one id neither is later, so that both stay whole."""
    found = line_dedup.dedup_lines(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the smallest id, and one row of it. Rows without an id, or
    without words, are classes of their own; of those that are equal one stays."""
    classes = order_minhash.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(classes, F.col("doc_id").eqNullSafe(F.col("__kept")), "left_semi").select(COLUMNS).dropDuplicates(["doc_id", "text"])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows of one id are its copies. Null texts have no words and are not taken
    beyond their whole copies; a null source is a source of its own."""
    taken = mixing.mix(docs.select(COLUMNS), keep=COLUMNS)
    return taken.where("copies > 0").withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: a null or empty text is its end alone, and each row is packed for itself."""
    return packing.pack_documents(docs)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("mix", mix), ("pack", pack)]
#: Language machines, alignments and tokens aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name, free=True)
    return STAGES[-1][1](spark, docs, sf_dir)
