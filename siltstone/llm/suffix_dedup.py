"""Removal of repeated byte strings of a fixed length, by suffixes sorted bucket by bucket.

A cover of sample positions stands in for the suffix array of the whole corpus: of every ``length`` bytes the run of
SAMPLE bytes with the least hash is a sample, so that two equal strings hold equal samples at the same place. (A
periodic difference cover has that property too, but with four times as many samples; this one depends on the bytes.)
A sample's rank is the class of its run, and the second rank the class of all bytes within reach of it.

A bucket is all suffixes through samples of one rank. Suffixes whose second ranks are equal are tied over their whole
length, which needs no byte of them; what is left of a bucket is sorted by its bytes, and neighbours' common length tells
which strings repeat. Ranks and second ranks are 64-bit hashes: they settle ties, and the bytes settle the order.
Buckets are read one after another by each task. One above BUCKET is dealt out anew by the bytes that strings of about the same start share. What is
still above it is cut into parts of about that size, so that memory is bounded; only the first of each string in each
part is then compared with those of the other parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, utf8

LENGTH, SAMPLE = 100, 24
#: Places with bytes of their own that a task sorts together.
BUCKET = 2048
#: Ranges of starts that a large bucket is cut into.
RANGES = 4
PRIME = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(PRIME), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best of every ``width`` neighbours, by doubling."""
    n, k = len(x) - width + 1, 1
    while k * 2 <= width:
        x = best(x[:-k], x[k:])
        k *= 2
    return best(x[:n], x[width - k : width - k + n])


def samples(data: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, position in it, rank, second rank, bytes before and after the position within reach) of each sample."""
    size, width = np.diff(at), length - SAMPLE + 1
    if len(data) < length or size.max(initial=0) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64, np.int64))
    power = np.cumprod(np.full(len(data), PRIME, np.uint64))
    back = np.cumprod(np.full(len(data), INVERSE, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)])
    rank = _mix((sums[SAMPLE:] - sums[:-SAMPLE]) * back[: len(data) - SAMPLE + 1])
    least = _sliding(rank, width, np.minimum)
    text_end = np.repeat(at[1:], size)
    least = np.where(np.arange(len(least)) + length <= text_end[: len(least)], least, np.uint64(0))  # strings within one text
    edge = np.zeros(width - 1, np.uint64)
    chosen = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), width, np.maximum)[: len(rank)] == rank)
    text = np.searchsorted(at, chosen, "right") - 1
    chosen, text = (v[chosen + SAMPLE <= at[text + 1]] for v in (chosen, text))
    before = np.minimum(chosen - at[text], length - SAMPLE)
    after = np.minimum(at[text + 1] - chosen, length)
    start = chosen - before
    second = _mix((sums[chosen + after] - sums[start]) * back[start] + (before * 1024 + after).astype(np.uint64))
    enough = before + after >= length
    return tuple(v[enough] for v in (text, chosen - at[text], rank[chosen].view(np.int64), second.view(np.int64), before, after))


def within(before: np.ndarray, after: np.ndarray, low: np.ndarray, high: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which strings through each sample (columns: how far before it they start) are in its text and start at low to high - 1."""
    o = np.arange(length - SAMPLE + 1)
    before, after, low, high = (v[:, None] for v in (before, after, low, high))
    return (before >= o) & (after >= length - o) & (low <= o) & (o < high)


def ordered(bucket: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of their bucket and bytes, and how many bytes each has in common with the row before (-1 in another bucket)."""
    whole = np.concatenate([bucket.astype(">u8").view(np.uint8).reshape(-1, 8), text], axis=1)
    order = np.argsort(np.ascontiguousarray(whole).view(f"V{whole.shape[1]}").ravel(), kind="stable")
    rows = whole[order]
    same = np.concatenate([rows[1:] == rows[:-1], np.zeros((len(rows) - 1, 1), bool)], axis=1)
    common = same.argmin(axis=1) - 8
    return order, np.concatenate([[-1], np.where(common < 0, -1, common)])


def classes(order: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """A number for each row, which rows share that agree in ``least`` bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < least)
    return out


def repeats(bucket: np.ndarray, context: np.ndarray, inside: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which strings of ``inside`` also stand in an earlier row of their bucket.

    Rows are in the order of their places; ``context`` has the bytes from length - SAMPLE before to ``length`` after. The
    suffixes from the samples on are sorted, and so are the bytes before them, read backwards; strings are equal if neighbours in
    both orders agree far enough.
    """
    reach = length - SAMPLE
    out = np.zeros((len(context), reach + 1), bool)
    if len(context) < 2:
        return out
    after, before = ordered(bucket, context[:, reach:]), ordered(bucket, context[:, :reach][:, ::-1])
    for o in range(reach + 1):
        rows = np.flatnonzero(inside[:, o])
        key = classes(*after, length - o)[rows] * (len(context) + 1) + classes(*before, o)[rows]
        order = np.argsort(key, kind="stable")
        out[rows[order[1:]][key[order][1:] == key[order][:-1]], o] = True
    return out


def _runs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, last column) of each run of true cells."""
    edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def remove_repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: key, n_bytes, n_removed, n_spans, kept (the text's remaining bytes), spans.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a row of smaller id, or in the
    same row before. Spans are the maximal removed runs, as (start, end) in bytes. A null text is empty. A null id comes
    first. Rows with one id and one text are one document, each with its result; texts that share an id are ordered by
    a hash. Keys are whole numbers. Other columns are left out.
    """
    reach = length - SAMPLE
    tag = F.coalesce(F.hash(F.col(text)), F.lit(0))
    picked = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("id"), tag.alias("tag"), F.col(text).alias("__text"))
    PLACE = ["id", "tag", "pos"]

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", 1 << 21):
            row, pos, rank, second, before, after = samples(*utf8(batch.column("__text")), length)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rank), pa.array(second), batch.column("id").take(take), batch.column("tag").take(take), pa.array(pos, pa.int32()), pa.array(before * 1024 + after, pa.int32())],
                ["rank", "second", *PLACE, "around"],
            )

    found = picked.drop("__key").mapInArrow(sample, "rank long, second long, id long, tag int, pos int, around int")
    found = cut(found, "samples", free=True)
    several = found.groupBy("rank").agg(F.count("*").alias("n"), (F.min("second") < F.max("second")).alias("differ")).where("n > 1").select("rank", "differ")
    tied = cut(found.join(cut(several, "samples-several"), "rank"), "samples-tied", free=True)
    first = tied.groupBy("rank", "second", "differ").agg(F.min(F.struct(*PLACE, "around")).alias("first"))
    first = cut(first, "samples-first", free=True)
    place = F.struct(*PLACE)
    later = tied.join(first.select("rank", "second", F.struct(*(F.col(f"first.{c}") for c in PLACE)).alias("first")), ["rank", "second"]).where(place > F.col("first"))
    start = F.col("pos") - F.floor(F.col("around") / 1024).cast("int")
    whole = cut(later.select("id", "tag", start.alias("a"), (F.col("pos") + F.col("around") % 1024).alias("b")), "spans", free=True)

    # what second ranks don't settle: bytes around the first places
    asked = first.where("differ").select("rank", "first.*").groupBy("id", "tag").agg(F.collect_list(F.struct("rank", "pos", "around")).alias("asked"))
    width = reach + length

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", 1 << 21):
            data, at = utf8(batch.column("__text"))
            lists = batch.column("asked")
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            rank, pos, around = (np.asarray(c) for c in lists.flatten().flatten())
            padded = np.concatenate([np.zeros(reach, np.uint8), data, np.zeros(length, np.uint8)])
            view = np.lib.stride_tricks.sliding_window_view(padded, width)
            for i in range(0, len(row), 8192):
                some = slice(i, i + 8192)
                context = view[at[row[some]] + pos[some]]
                take = pa.array(row[some])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rank[some]), batch.column("id").take(take), batch.column("tag").take(take), pa.array(pos[some]), pa.array(around[some]), pa.array([c.tobytes() for c in context], pa.binary())],
                    ["rank", *PLACE, "around", "context"],
                )

    joined = picked.drop("__key").join(asked, ["id", "tag"]).dropDuplicates(["id", "tag"])
    held = cut(joined.select("id", "tag", "__text", "asked").mapInArrow(contexts, "rank long, id long, tag int, pos int, around int, context binary"), "contexts", free=True)

    def parts(rows: DataFrame, name: str) -> DataFrame:
        """In how many parts each bucket of two places or more is dealt out."""
        n = F.count("*")
        return cut(rows.groupBy("rank").agg(F.ceil(n / BUCKET).cast("int").alias("parts"), n.alias("n")).where("n > 1").select("rank", "parts"), name, free=True)

    SIDES = ["around", "context", "low", "high"]
    sizes = parts(held, "buckets")
    cold = held.join(sizes.where("parts = 1"), "rank").withColumns({"low": F.lit(0), "high": F.lit(reach + 1)})
    # of a large bucket, strings that start at about the same distance before the sample share most of their bytes: buckets by those
    edges = [reach * k // RANGES for k in range(RANGES)] + [reach + 1]
    shared = lambda a, b: F.substring("context", reach - a + 1, length - (b - 1 - a))
    ranges = F.array(*(F.struct(F.xxhash64("rank", F.lit(a), shared(a, b)).alias("rank"), F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in zip(edges, edges[1:])))
    hot = cut(held.join(sizes.where("parts > 1"), "rank").select(*PLACE, "around", "context", F.explode(ranges).alias("r")).select("r.*", *PLACE, "around", "context"), "ranges", free=True)
    hot = hot.join(parts(hot, "range-buckets"), "rank")
    part = F.pmod(F.xxhash64(*PLACE), F.col("parts"))
    dealt = cold.unionByName(hot).select(F.xxhash64("rank", part).alias("rank"), *PLACE, *SIDES, (F.col("parts") > 1).alias("several"))

    def arrays(frame: pa.RecordBatch) -> tuple:
        context = np.frombuffer(b"".join(frame.column("context").to_pylist()), np.uint8).reshape(-1, width)
        around = frame.column("around").to_numpy()
        return frame.column("rank").to_numpy().view(np.uint64), context, within(around // 1024, around % 1024, frame.column("low").to_numpy(), frame.column("high").to_numpy(), length)

    found_schema = "id long, tag int, a int, b int, string binary"

    def compare(frame: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Repeated strings of whole parts as spans; of buckets in several parts also the first of each string in this one."""
        bucket, context, inside = arrays(frame)
        again = repeats(bucket, context, inside, length)
        pos, several = frame.column("pos").to_numpy(), frame.column("several").to_numpy(zero_copy_only=False)

        def rows(at: np.ndarray, a: np.ndarray, b: np.ndarray, strings: pa.Array) -> pa.RecordBatch:
            take = pa.array(at)
            return pa.RecordBatch.from_arrays([frame.column("id").take(take), frame.column("tag").take(take), pa.array(a, pa.int32()), pa.array(b, pa.int32()), strings], ["id", "tag", "a", "b", "string"])

        at, first, last = _runs(again)
        yield rows(at, pos[at] - last, pos[at] - first + length, pa.nulls(len(at), pa.binary()))
        for o in range(reach + 1) if several.any() else ():
            at = np.flatnonzero(several & ~again[:, o] & inside[:, o])
            keys = [hashlib.blake2b(c.tobytes(), digest_size=16).digest() for c in context[at, reach - o : reach - o + length]]
            yield rows(at, pos[at] - o, pos[at] - o + length, pa.array(keys, pa.binary()))

    def sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole parts, as many at once as fill some thousand rows; one may go on in the next batch."""
        left: list[pa.RecordBatch] = []
        for batch in batches:
            for i in range(0, batch.num_rows, BUCKET):
                left.append(batch.slice(i, BUCKET))
                rank = left[-1].column("rank").to_numpy()
                last = len(rank) - int((rank[::-1] != rank[-1]).argmax()) if rank[0] != rank[-1] else 0
                if last:
                    ended = [*left[:-1], left[-1].slice(0, last)]
                    left = [left[-1].slice(last)]
                    yield from compare(pa.Table.from_batches(ended).combine_chunks().to_batches()[0])
        if left:
            yield from compare(pa.Table.from_batches(left).combine_chunks().to_batches()[0])

    dealt = dealt.repartition("rank").sortWithinPartitions("rank", *PLACE)
    compared = cut(dealt.mapInArrow(sort_buckets, found_schema), "compared", free=True)
    strings = compared.where("string is not null").select("string", F.struct("id", "tag", F.col("a").alias("pos")).alias("place"))
    earliest = strings.groupBy("string").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select("string", "first")
    apart = strings.join(earliest, "string").where(F.col("place") > F.col("first")).select("place.id", "place.tag", F.col("place.pos").alias("a"), (F.col("place.pos") + length).alias("b"))

    sorted_spans = compared.where("string is null").drop("string")
    marks = cut(whole.unionByName(sorted_spans).unionByName(apart), "marks", free=True)
    marks = marks.groupBy("id", "tag").agg(F.collect_list(F.struct("a", "b")).alias("marks"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            data, at = utf8(batch.column("__text"))
            n, removed, kept, out = np.diff(at), [], [], []
            for i, m in enumerate(batch.column("marks")):
                raw, gone = data[at[i] : at[i + 1]], []
                if m.is_valid:
                    a, b = (np.asarray(c) for c in m.values.flatten())
                    change = np.bincount(a, minlength=n[i] + 1) - np.bincount(b, minlength=n[i] + 1)
                    covered = np.cumsum(change[: n[i]]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
                    gone, raw = edge.reshape(-1, 2).tolist(), raw[~covered]
                out.append([{"start": a, "end": b} for a, b in gone])
                removed.append(sum(b - a for a, b in gone))
                kept.append(raw.tobytes())
            spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("__key"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(x) for x in out], pa.int64()), pa.array(kept, pa.binary()), pa.array(out, spans_type)],
                ["__key", "n_bytes", "n_removed", "n_spans", "kept", "spans"],
            )

    kind = picked.schema["__key"].dataType.simpleString()
    out = picked.join(marks, ["id", "tag"], "left").select("__key", "__text", "marks")
    return out.mapInArrow(rewrite, f"__key {kind}, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:int,end:int>>").withColumnRenamed("__key", key)


#: The same in DuckDB's SQL, for ids that are unique: all strings of 100 bytes by their md5, from overlapping pieces of the texts in hexadecimal.
REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
c AS (SELECT doc_id, k * 512 AS base, substr(h, k * 1024 + 1, 1222) AS piece, n FROM b, unnest(range(0, greatest(0, n - 100) // 512 + 1)) r(k) WHERE n >= 100),
s AS (SELECT doc_id, base + o AS pos, md5(substr(piece, 2 * o + 1, 200)) AS key FROM c, unnest(range(0, 512)) q(o) WHERE base + o + 100 <= n),
f AS (SELECT key, min(struct_pack(doc_id, pos)) AS first FROM s GROUP BY key HAVING count(*) > 1),
l AS (SELECT doc_id, pos FROM s JOIN f USING (key) WHERE struct_pack(doc_id, pos) > first),
g AS (SELECT doc_id, pos, pos > lag(pos) OVER w + 100 OR lag(pos) OVER w IS NULL AS opens FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM g),
x AS (SELECT doc_id, min(pos) AS a, max(pos) + 100 AS z FROM r GROUP BY doc_id, run),
k AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM x),
p AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS upto, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM k JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(CASE WHEN p.doc_id IS NULL THEN h ELSE kept || substr(h, 2 * upto + 1) END)) AS kept_sha256 FROM b LEFT JOIN p USING (doc_id)
"""
