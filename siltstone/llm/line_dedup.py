"""Line dedup by winnowing.

Of every WINDOW consecutive lines the one with the least hash is a fingerprint, and so is every line with half of LONG
words or more: two equal runs of WINDOW lines, or of fewer with LONG words together, hold a fingerprint at the same place.
Each fingerprint is one row, by the hash of its line alone, with its place and the lines next to it.

Places of one fingerprint are joined, and from there a match is extended line by line to both sides, as far as two
fingerprints can be apart; a later place whose match has WINDOW lines, or LONG words, goes with the lines of the match.
What goes from one fingerprint and from the next touches or overlaps, which makes the whole run.

A line that is very common makes a fingerprint with more places than a task should hold. Those are extended first, by
the lines next to them, and then compared as what they are extended to, of which only the first place is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, slices, spread_join, whole_groups

#: Lines of the shortest run that is deleted, and words of one that has fewer. Blank lines don't count and are never deleted.
WINDOW, LONG = 3, 50
BLANK = " \t\r\f\v"
#: Places of a fingerprint that a task extends at once: at least FEW, and one in SHARE of all; so at most SHARE fingerprints have more, and
#: are broadcast.
FEW, SHARE = 256, 1 << 14
MARK = pa.struct([("pos", pa.int32()), ("key", pa.int64()), ("check", pa.int64()), ("words", pa.int32()), ("near", pa.list_(pa.int64())), ("near_words", pa.list_(pa.int32()))])


def winnow(hashes: np.ndarray, words: np.ndarray, window: int, long: int) -> np.ndarray:
    """Positions of the fingerprints: the last least hash of each window, and all lines with half of ``long`` words."""
    own = np.flatnonzero(2 * words >= long)
    if len(hashes) < window:
        return own
    view = np.lib.stride_tricks.sliding_window_view(hashes, window)
    least = np.arange(len(view)) + window - 1 - view[:, ::-1].argmin(axis=1)
    return np.union1d(own, least)


def extensions(window: int) -> list[tuple[int, int]]:
    """(lines before, lines after) of runs through a fingerprint of up to ``window`` lines."""
    return [(a, n - 1 - a) for n in range(1, window + 1) for a in range(n)]


def matched(words: np.ndarray, a: int, b: int, window: int, long: int) -> np.ndarray:
    """Which runs of a + 1 + b lines are long enough; ``words`` has a row for each fingerprint: its own and its neighbours' (-1: none)."""
    run = words[:, window - 1 - a : window + b]
    return (run >= 0).all(axis=1) & ((a + 1 + b >= window) | (run.sum(axis=1) >= long))


def dedup_lines(docs: DataFrame, window: int = WINDOW, long: int = LONG, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` with n_lines, n_removed and n_runs after its own columns, and ``text`` without the lines of
    runs of at least ``window`` lines, or of at least ``long`` words, that also stand earlier: in a row of smaller id, or
    earlier in the same text.

    Lines end at line feeds; n_lines counts those that aren't blank. A null text stays null and has no lines, a text all
    of whose lines go becomes empty. Null ids come first; rows that share an id are at one place, so that neither is
    later than the other at the same line. Columns of ``docs`` with a new column's name are left out.
    """
    new = ["n_lines", "n_removed", "n_runs"]
    own = [c for c in docs.columns if c not in new]
    side = window - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, text):
            count, size, pos, key_, check, own_words, near, near_words = [], [], [], [], [], [], [], []
            for t in batch.column(text).to_pylist():
                lines = [x.encode() for x in (t or "").split("\n") if x.strip(BLANK)]
                raw = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in lines]), ">i8").astype(np.int64).reshape(-1, 2)
                words = np.array([len(x.split()) for x in lines], np.int32)
                at = winnow(raw[:, 1].view(np.uint64), words, window, long)
                count.append(len(lines))
                size.append(len(at))
                pos.append(at)
                key_.append(raw[at, 0])
                check.append(raw[at, 1])
                around = at[:, None] + np.delete(np.arange(-side, side + 1), side)[None, :]
                there = (around >= 0) & (around < len(lines))
                around = np.where(there, around, 0)
                own_words.append(words[at])
                near.append(np.where(there, raw[around, 1], 0) if len(at) else np.zeros((0, 2 * side), np.int64))
                near_words.append(np.where(there, words[around], -1) if len(at) else np.zeros((0, 2 * side), np.int32))
            n, flat = batch.num_rows, lambda v, t: np.concatenate(v).astype(t)
            total = sum(size)
            each = pa.array(np.arange(total + 1) * 2 * side, pa.int32())
            marks = pa.StructArray.from_arrays(
                [
                    pa.array(flat(pos, np.int32)), pa.array(flat(key_, np.int64)), pa.array(flat(check, np.int64)), pa.array(flat(own_words, np.int32)),
                    pa.ListArray.from_arrays(each, pa.array(flat(near, np.int64).ravel())), pa.ListArray.from_arrays(each, pa.array(flat(near_words, np.int32).ravel())),
                ],
                fields=list(MARK),
            )
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), marks)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(row, row + n)), pa.array(count, pa.int64()), listed], [*names, "__row", "n_lines", "__marks"])
            row += n

    names = [f"__own{i}" for i in range(len(own))]  # so that no column of docs is taken for one of those made here
    picked = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(own, names)))
    of = dict(zip(own, names))
    key, text = of[key], of[text]
    more = T.StructType.fromDDL("__row long, n_lines long, __marks array<struct<pos:int,key:long,check:long,words:int,near:array<long>,near_words:array<int>>>")
    base = cut(picked.mapInArrow(run, T.StructType([*picked.schema.fields, *more.fields])), "lines", free=True)
    marks = base.select("__row", F.col(key).alias("id"), F.explode("__marks").alias("m")).select("__row", "id", "m.*")
    total = base.agg(F.sum(F.size("__marks"))).first()[0] or 0
    few = max(FEW, total // SHARE)
    counts = cut(marks.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "fingerprints", free=True)
    gone = "__row long, a int, b int"

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of whole fingerprints, by place."""
        for table in whole_groups(batches, "key"):
            n = table.num_rows
            key_, check, pos, row = (table.column(c).to_numpy() for c in ("key", "check", "pos", "__row"))
            ids = table.column("id").combine_chunks().dictionary_encode("encode").indices.to_numpy()
            # rows come in the order of their places, of which equal ones get one number
            place = np.cumsum(np.concatenate([[0], (ids[1:] != ids[:-1]) | (pos[1:] != pos[:-1])]))
            near = table.column("near").combine_chunks().flatten().to_numpy().reshape(n, -1)
            words = table.column("near_words").combine_chunks().flatten().to_numpy().reshape(n, -1)
            words = np.insert(words, side, table.column("words").to_numpy(), axis=1)
            for a, b in extensions(window):
                some = np.flatnonzero(matched(words, a, b, window, long))
                if len(some):
                    same = np.column_stack([key_[some], check[some], near[some][:, side - a : side + b]])
                    _, first, back = np.unique(same, axis=0, return_index=True, return_inverse=True)
                    later = some[place[some] > place[some][first][back.ravel()]]
                    yield pa.RecordBatch.from_arrays([pa.array(row[later]), pa.array(pos[later] - a, pa.int32()), pa.array(pos[later] + b, pa.int32())], ["__row", "a", "b"])

    cold = marks.join(counts.where(F.col("n") <= few).select("key"), "key")
    cold = cold.repartition("key").sortWithinPartitions("key", F.asc_nulls_first("id"), "pos")
    cold = cold.mapInArrow(extend, gone)

    hot = marks.join(F.broadcast(counts.where(F.col("n") > few).select("key")), "key")
    runs = []
    for a, b in extensions(window):
        lines = [F.element_at("near_words", i + 1) for i in range(side - a, side + b)]
        enough = F.lit(True) if a + 1 + b >= window else sum(lines, F.col("words")) >= long
        ok = enough
        for w in lines:
            ok = ok & (w >= 0)
        runs.append(F.when(ok, F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.slice("near", side - a + 1, a + b).alias("near"))))
    place = F.struct(F.col("id"), F.col("pos"))
    ran = hot.select("__row", "pos", place.alias("place"), "key", "check", F.explode(F.array_compact(F.array(*runs))).alias("r")).select("__row", "pos", "place", "key", "check", "r.*")
    by = ["key", "check", "a", "b", "near"]
    first = cut(ran.groupBy(*by).agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1"), "first-places", free=True)
    hot = spread_join(ran, first, by, few).where(F.col("place") > F.col("first")).select("__row", (F.col("pos") - F.col("a")).alias("a"), (F.col("pos") + F.col("b")).alias("b"))
    later = cold.unionByName(hot).distinct().groupBy("__row").agg(F.collect_list(F.struct("a", "b")).alias("__gone"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed, runs = [], [], []
            for t, lost in zip(batch.column(text).to_pylist(), batch.column("__gone").to_pylist()):
                if not lost:
                    texts.append(t), removed.append(0), runs.append(0)
                    continue
                drop = {i for x in lost for i in range(x["a"], x["b"] + 1)}
                kept, i = [], 0
                for line in t.split("\n"):
                    if not line.strip(BLANK):
                        kept.append(line)
                    else:
                        if i not in drop:
                            kept.append(line)
                        i += 1
                texts.append("\n".join(kept)), removed.append(len(drop)), runs.append(sum(i - 1 not in drop for i in drop))
            columns = [pa.array(texts, pa.string()) if n == text else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("n_lines"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())], [*names, *new])

    out = base.drop("__marks").join(later, "__row", "left").drop("__row")
    out = out.mapInArrow(rewrite, T.StructType([*picked.schema.fields, *(T.StructField(c, T.LongType()) for c in new)]))
    return out.select(*(F.col(n).alias(c) for c, n in of.items()), *new)


def _sql(window: int = WINDOW, long: int = LONG) -> str:
    grams, later, gone = [], [], []
    for n in range(1, window + 1):
        text = " || chr(10) || ".join(["line", *(f"lead(line, {k}) OVER p" for k in range(1, n))])
        words = " + ".join(["words", *(f"lead(words, {k}) OVER p" for k in range(1, n))])
        grams.append(f"CASE WHEN {n >= window} OR {words} >= {long} THEN {text} END AS gram{n}")
        later.append(f"gram{n} IS NOT NULL AND row_number() OVER (PARTITION BY gram{n} ORDER BY doc_id, pos) > 1 AS later{n}")
        gone += [f"coalesce(lag(later{n}, {k}) OVER p, false)" for k in range(n)]
    return rf"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents),
u AS (SELECT doc_id, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS i FROM d),
l AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM u WHERE NOT regexp_full_match(line, '[ \t\r\f\v]*')),
g AS (SELECT doc_id, i, pos, {", ".join(grams)} FROM l WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
m AS (SELECT *, {", ".join(later)} FROM g),
r AS (SELECT doc_id, i, pos, {" OR ".join(gone)} AS gone FROM m WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
c AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM r),
k AS (SELECT u.doc_id, count(pos) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_runs,
             coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE gone IS DISTINCT FROM true), '') AS kept FROM u LEFT JOIN c USING (doc_id, i) GROUP BY u.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs, md5(kept) AS kept_md5
FROM d LEFT JOIN k USING (doc_id)
"""


DEDUP_SQL = _sql()
