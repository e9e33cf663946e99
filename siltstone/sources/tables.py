"""Tables that change together, in numbered states.

A state is a file named by its number. It lists, for each table, segments: folders of Parquet that are written once. A
commit adds segments with the new rows of the keys that it touches, and a list of these keys, whose older rows are void from
then on; nothing else is written anew. Readers see all tables of one state.

States are published by creating the next number's file, whole and exclusively, so that of two writers of one number one
fails: it looks at what was committed meanwhile, and either takes the number after it or, where both touched a key, raises
``Conflict``. A writer that is killed leaves folders that no state lists. ``merge`` puts a table's segments together, and
``clean`` removes old states and folders that no kept state needs.

Names are published by a hard link on local file systems and by a rename elsewhere, which must fail on a name that is
there, as HDFS's does.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from functools import reduce
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Parts that keys are counted in, by which two commits see that they touch no common key; bytes of keys that are broadcast at most.
BUCKETS, BROADCAST = 1024, 16 << 20


class Conflict(RuntimeError):
    """Another commit touched the same keys, or replaced all tables, after the state that this one started from."""


def _fs(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, folder = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []


def _numbers(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n[:-5]) for n in _names(spark, f"{root}/states") if n.endswith(".json") and n[:-5].isdigit())


def _publish(spark: SparkSession, root: str, number: int, state: dict) -> bool:
    """Whether the state could take this number."""
    fs, draft = _fs(spark, f"{root}/states/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    _, final = _fs(spark, f"{root}/states/{number:012d}.json")
    if fs.getScheme() == "file":
        local = lambda p: unquote(urlparse(p.toString()).path)
        try:
            os.link(local(draft), local(final))
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(draft, False)
    if not fs.exists(final) and fs.rename(draft, final):
        return True
    fs.delete(draft, False)
    return False


def current(spark: SparkSession, root: str) -> int | None:
    """The number of the newest state; None before the first."""
    return max(_numbers(spark, root), default=None)


def state_of(spark: SparkSession, root: str, number: int) -> dict:
    fs, path = _fs(spark, f"{root}/states/{number:012d}.json")
    stream = fs.open(path)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def read_table(spark: SparkSession, root: str, name: str, number: int | None = None) -> DataFrame:
    """A table in the newest state, or in that of ``number``."""
    number = current(spark, root) if number is None else number
    if number is None:
        raise FileNotFoundError(f"no tables under {root}")
    state = state_of(spark, root, number)
    table = state["tables"][name]
    schema, key = StructType.fromJson(table["schema"]), table["key"]
    parts = [spark.read.schema(schema).parquet(f"{root}/data/{s['path']}").withColumn("__from", F.lit(s["number"])) for s in table["segments"]]
    rows = reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema).withColumn("__from", F.lit(0))
    first = min((s["number"] for s in table["segments"]), default=number)
    voids = [v for v in state["voids"] if v["number"] > first and v["table"] in (None, name)] if key else []
    if voids:
        kind = schema[key].dataType
        gone = reduce(DataFrame.unionAll, [spark.read.parquet(f"{root}/data/{v['path']}").select(F.col("key").cast(kind).alias("__key"), F.lit(v["number"]).alias("__void")) for v in voids])
        gone = gone.groupBy("__key").agg(F.max("__void").alias("__void"))
        gone = F.broadcast(gone) if sum(v["bytes"] for v in voids) <= BROADCAST else gone
        rows = rows.join(gone, F.col(key).eqNullSafe(F.col("__key")), "left").where("__void IS NULL OR __from >= __void")
    return rows.select(*schema.names)


def read_tables(spark: SparkSession, root: str, names: list[str], number: int | None = None) -> dict[str, DataFrame]:
    """All of one state."""
    number = current(spark, root) if number is None else number
    return {n: read_table(spark, root, n, number) for n in names}


def _write(df: DataFrame, path: str, by: list[str]) -> None:
    (df.write.partitionBy(*by) if by else df.write).parquet(path)


def _commit(spark: SparkSession, root: str, base: int | None, change: Callable[[dict, int], dict], clashes: Callable[[dict], bool]) -> int:
    """Publish ``change`` of the newest state under the next number; ``clashes``: whether a state after ``base`` forbids it."""
    seen = base or 0
    while True:
        number = current(spark, root) or 0
        for n in range(seen + 1, number + 1):
            if clashes(state_of(spark, root, n)):
                raise Conflict(f"state {n} of {root} touches what this commit does, which started from {base}")
        seen = number
        before = state_of(spark, root, number) if number else {"tables": {}, "voids": []}
        if _publish(spark, root, number + 1, change(before, number + 1)):
            return number + 1


def commit(
    spark: SparkSession, root: str, rows: dict[str, DataFrame], touched: DataFrame | dict[str, DataFrame] | None = None, key: str = "source_url", base: int | None = None, by: dict[str, list[str]] | None = None, mark: tuple[str, int] | None = None
) -> int:
    """The number of a new state in which ``rows`` stand in their tables, and older rows of the keys of ``touched`` don't: of all tables, or
    of those that it names.

    ``base``: the state that the rows were computed from, by default the newest; ``key``: the column of keys in ``touched`` and in those of the
    tables that have it, others only grow; ``by``: columns that a table's folders are divided by; ``mark``: a stream's name and the number of
    its batch, which is part of the state: a batch that the newest state already has, or a later one of the stream, changes nothing.
    """
    base = current(spark, root) if base is None else base
    if mark and base and mark[1] <= state_of(spark, root, base).get("marks", {}).get(mark[0], -1):
        return base
    folder = uuid.uuid4().hex
    for name, df in rows.items():
        _write(df, f"{root}/data/{folder}/{name}", (by or {}).get(name, []))
    voids = []
    for i, (name, df) in enumerate((touched if isinstance(touched, dict) else {None: touched} if touched is not None else {}).items()):
        path = f"{folder}/__keys{i}"
        df.select(F.col(key).alias("key")).distinct().withColumn("bucket", F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(BUCKETS)).cast("int")).write.parquet(f"{root}/data/{path}")
        told = spark.read.parquet(f"{root}/data/{path}").agg(F.sort_array(F.collect_set("bucket")), F.sum(16 + F.coalesce(F.octet_length(F.col("key").cast("string")), F.lit(0)))).first()
        voids.append({"table": name, "path": path, "bytes": told[1] or 0, "buckets": told[0]})

    def clashes(other: dict) -> bool:
        if other["kind"] == "replace" or mark and other.get("marks", {}).get(mark[0], -1) >= mark[1]:
            return True
        keys = lambda v: spark.read.parquet(f"{root}/data/{v['path']}").select(F.col("key").cast("string"))
        for theirs in other["voids"] if other["kind"] == "commit" else []:
            for mine in voids:
                apart = mine["table"] and theirs["table"] and mine["table"] != theirs["table"]
                if theirs["number"] == other["number"] and not apart and set(mine["buckets"]) & set(theirs["buckets"]):
                    if not keys(mine).join(keys(theirs).withColumnRenamed("key", "__key"), F.col("key").eqNullSafe(F.col("__key")), "left_semi").isEmpty():
                        return True
        return False

    def change(before: dict, number: int) -> dict:
        tables = dict(before["tables"])
        for name, df in rows.items():
            old = tables.get(name, {"segments": []})
            schema = old.get("schema") or json.loads(spark.read.parquet(f"{root}/data/{folder}/{name}").select(*df.columns).schema.json())
            tables[name] = {"key": old.get("key") or (key if key in df.columns else None), "schema": schema, "segments": [*old["segments"], {"number": number, "path": f"{folder}/{name}"}]}
        return {"number": number, "kind": "commit", "tables": tables, "voids": [*before["voids"], *(v | {"number": number} for v in voids)], "marks": before.get("marks", {}) | ({mark[0]: mark[1]} if mark else {})}

    return _commit(spark, root, base, change, clashes)


def write_tables(spark: SparkSession, root: str, tables: dict[str, DataFrame], key: str | None = None, by: dict[str, list[str]] | None = None) -> int:
    """Replace all tables by these as one new state. It conflicts with any commit since it began."""
    base = current(spark, root)
    folder = uuid.uuid4().hex
    held = {}
    for name, df in tables.items():
        _write(df, f"{root}/data/{folder}/{name}", (by or {}).get(name, []))
        held[name] = {"key": key if key in df.columns else None, "schema": json.loads(df.schema.json()), "segments": [{"path": f"{folder}/{name}"}]}

    def change(before: dict, number: int) -> dict:
        return {"number": number, "kind": "replace", "voids": [], "marks": before.get("marks", {}), "tables": {n: t | {"segments": [s | {"number": number} for s in t["segments"]]} for n, t in held.items()}}

    return _commit(spark, root, base, change, lambda other: True)


def merge(spark: SparkSession, root: str, remake: dict[str, Callable[[DataFrame], DataFrame]] | None = None, by: dict[str, list[str]] | None = None) -> int | None:
    """A state with the same rows in one segment for each table; ``remake``: what becomes of a table's rows on the way. Commits that other writers
    made meanwhile stand; only another merge or a replacement conflicts."""
    base = current(spark, root)
    if base is None:
        return None
    folder = uuid.uuid4().hex
    names = list(state_of(spark, root, base)["tables"])
    for name in names:
        _write((remake or {}).get(name, lambda df: df)(read_table(spark, root, name, base)), f"{root}/data/{folder}/{name}", (by or {}).get(name, []))

    def change(before: dict, number: int) -> dict:
        tables = dict(before["tables"])
        for name in names:
            later = [s for s in tables[name]["segments"] if s["number"] > base]
            tables[name] = tables[name] | {"segments": [{"number": base, "path": f"{folder}/{name}"}, *later]}
        return {"number": number, "kind": "merge", "tables": tables, "voids": [v for v in before["voids"] if v["number"] > base], "marks": before.get("marks", {})}

    return _commit(spark, root, base, change, lambda other: other["kind"] in ("merge", "replace"))


def clean(spark: SparkSession, root: str, keep: int = 10, grace_seconds: float = 7 * 86_400) -> list[str]:
    """The names of the folders that were deleted: those that none of the last ``keep`` states lists and that are older than ``grace_seconds``, which a
    writer must not take longer than. Older states go as well, so that who reads one must not take longer than ``keep`` commits."""
    numbers = _numbers(spark, root)
    for n in numbers[:-keep]:
        fs, path = _fs(spark, f"{root}/states/{n:012d}.json")
        fs.delete(path, False)
    used = set()
    for n in numbers[-keep:]:
        state = state_of(spark, root, n)
        used |= {s["path"].split("/")[0] for t in state["tables"].values() for s in t["segments"]} | {v["path"].split("/")[0] for v in state["voids"]}
    fs, data = _fs(spark, f"{root}/data")
    gone, now = [], time.time()
    for s in fs.listStatus(data) if fs.exists(data) else []:
        if s.getPath().getName() not in used and now - s.getModificationTime() / 1000 >= grace_seconds:
            fs.delete(s.getPath(), True)
            gone.append(s.getPath().getName())
    return gone
