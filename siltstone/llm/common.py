"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into numpy arrays at once; a single longer text is its own slice.
SLICE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Where that is unset there must be no cluster: a local session,
    as in tests, gets a folder under /tmp."""
    conf = spark.sparkContext.getConf()
    if folder := conf.get("spark.checkpoint.dir"):
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return "file:///tmp/siltstone-checkpoints"


def cut(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back: its lineage ends there.

    The files outlive lost executors and go when the application ends. ``free``: shuffle files that nothing refers to any
    more go now, rather than when the driver next collects garbage; for operators that shuffle several times their input.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/siltstone-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    if free:
        del df
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``cut`` returned, once all that is made of them is written."""
    for df in tables:
        spark = df.sparkSession
        jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string or binary column as UTF-8 bytes; null reads as empty. Offsets start at 0."""
    c = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(c, pa.ChunkedArray):
        c = c.combine_chunks()
    _, offsets, data = c.buffers()
    at = np.frombuffer(offsets, np.int64)[c.offset : c.offset + len(c) + 1] if len(c) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most ``limit`` bytes of ``text``, or one row."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def whole_groups(batches: Iterator[pa.RecordBatch], by: str, rows: int = 1 << 15) -> Iterator[pa.Table]:
    """Sorted rows as tables of whole groups, as many at once as make up about ``rows``; a group may go on from one batch to
    the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        name = batch.column(by).to_numpy()
        last = len(name) - int((name[::-1] != name[-1]).argmax()) if name[0] != name[-1] else 0  # where the last group begins
        if sum(b.num_rows for b in held) >= rows and held[-1].column(by)[-1].as_py() != name[0]:
            yield pa.Table.from_batches(held)
            held = []
        if last and sum(b.num_rows for b in held) + last >= rows:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def spread_join(rows: DataFrame, facts: DataFrame, by: list[str], limit: int) -> DataFrame:
    """``rows`` joined with ``facts``, which has one row for each ``by`` and ``n``, how many of ``rows`` it meets.

    Facts that meet more than ``limit`` rows are broadcast, so that no task gets all rows of one; there are at most as many as rows
    divided by ``limit``. All others are joined by shuffles.
    """
    often = F.broadcast(facts.where(F.col("n") > limit))
    rest = rows.join(often.select(*by), by, "left_anti").join(facts.where(F.col("n") <= limit), by)
    return rows.join(often, by).unionByName(rest)


def salted_join(rows: DataFrame, facts: DataFrame, by: str, spread: str, limit: int) -> DataFrame:
    """``rows`` joined with ``facts``, which has one row for each ``by``; a ``by`` with more than ``limit`` rows is dealt out by
    ``spread``, and its fact copied to each part. What is broadcast are the numbers of parts of such keys."""
    parts = F.broadcast(rows.groupBy(by).agg(F.ceil(F.count("*") / limit).cast("int").alias("__parts")).where("__parts > 1"))
    salt = F.coalesce(F.pmod(F.xxhash64(spread), F.col("__parts")), F.lit(0)).cast("int")
    dealt = rows.join(parts, by, "left").withColumn("__salt", salt).drop("__parts")
    copied = facts.join(parts, by, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return dealt.join(copied, [by, "__salt"]).drop("__salt")
