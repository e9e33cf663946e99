"""Near-duplicate texts by Order MinHash.

Of a text's occurrence-labelled runs of three words each sketch keeps the two with the least hashes, in the order of the
text, so that texts share sketches as their edit similarity is high. Texts that share one are candidates; a banded
alignment of their words verifies them.

All pairs of a bucket of texts with one sketch are settled: two texts are aligned, or links join them already, or their
lengths and counts of words rule them out. Each text is compared with the first text of one of its buckets. Buckets whose
members links don't join then are cut in blocks, and a task compares one block with another; it passes on links, not
pairs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, salted_join, slices, utf8, whole_groups
from .components import components

#: Words of a run, and sketches of a text. With a share s of single-word edits spread over a text p = (1 - s)^RUN of its runs
#: stay, two such texts have p / (2 - p) of their runs in common, and a sketch needs two: 0.98 of pairs at SIMILAR share one.
RUN = 3
SKETCHES = 32
#: Texts of one bucket, and words of them all, that a task compares with as many others of it at once.
GROUP, WORDS = 1024, 2_000_000
#: Pairs of one lead that a task aligns.
LEADS = 1000
#: Edits that the first band of an alignment holds.
FIRST_BAND = 32
#: Counters of a text's words by hash, whose differences bound the edits between two texts from below.
BINS = 256
SIMILAR = 0.8
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a hash of each word between white space, in order, and how many words each text has)."""
    n, size = len(at) - 1, np.diff(at)
    out = np.full(len(data) + n + 1, 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(n) + 1, size)] = data
    inside = ~SPACE[out]
    begin, end = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1, np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    power = np.cumprod(np.full(len(out), PRIME, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((out.astype(np.uint64) + np.uint64(1)) * power)])
    back = np.cumprod(np.full(len(out), np.uint64(pow(int(PRIME), -1, 1 << 64)), np.uint64))
    words = _mix((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64))
    return words, np.diff(np.searchsorted(begin, at + np.arange(n + 1)))


def sketches(data: np.ndarray, at: np.ndarray, count: int = SKETCHES) -> tuple[np.ndarray, np.ndarray]:
    """(which texts have a word, their sketches: a row of ``count`` 64-bit numbers each)."""
    words, n = word_hashes(data, at)
    some = np.flatnonzero(n)
    n = n[some]
    if not len(some):
        return some, np.zeros((0, count), np.int64)
    runs = np.maximum(1, n - RUN + 1)
    first = np.concatenate([[0], np.cumsum(runs)])
    text = np.repeat(np.arange(len(n)), runs)
    where = np.arange(first[-1]) - first[text]
    start = (np.cumsum(n) - n)[text] + where
    gram = np.zeros(len(start), np.uint64)
    padded = np.concatenate([words, np.zeros(RUN, np.uint64)])
    for k in range(RUN):
        gram = gram * PRIME + np.where(where + k < n[text], padded[start + k], np.uint64(0))
    gram = _mix(gram)
    # occurrence labels
    order = np.lexsort((where, gram, text))
    again = np.concatenate([[False], (gram[order][1:] == gram[order][:-1]) & (text[order][1:] == text[order][:-1])])
    at_first = np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))
    label = np.empty(len(order), np.uint64)
    label[order] = np.arange(len(order)) - at_first
    gram = _mix(gram + label * PRIME)
    out, begin = np.empty((len(n), count), np.uint64), first[:-1]
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    for j in range(count):
        h = _mix(gram ^ _mix(np.array([j + 1], np.uint64) * PRIME))
        least = np.flatnonzero(h == np.minimum.reduceat(h, begin)[text])
        p = np.empty(len(n), np.int64)
        p[text[least]] = least
        h[p] = most
        least = np.flatnonzero(h == np.minimum.reduceat(h, begin)[text])
        q = np.empty(len(n), np.int64)
        q[text[least]] = least
        a, b = gram[np.minimum(p, q)], np.where(runs > 1, gram[np.maximum(p, q)], np.uint64(0))
        out[:, j] = _mix(_mix(a + np.uint64(j)) * PRIME + b)
    return some, out.view(np.int64)


def profiles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(how many words each text has, a row of BINS counts of its words by hash, 255 for more)."""
    words, n = word_hashes(data, at)
    bins = np.repeat(np.arange(len(n)) * BINS, n) + (words % np.uint64(BINS)).astype(np.int64)
    return n, np.minimum(np.bincount(bins, minlength=len(n) * BINS), 255).astype(np.uint8).reshape(-1, BINS)


def apart(n: np.ndarray, counts: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of rows have fewer words in common than a similarity of ``least`` needs, whatever their order."""
    most = np.floor((1 - least) * np.maximum(n[left], n[right]) + 1e-9)
    gap = counts[left].astype(np.int16) - counts[right]
    over = np.maximum(gap, 0).sum(axis=1, dtype=np.int64)
    return np.maximum(over, over - gap.sum(axis=1, dtype=np.int64)) > most


def distance(a: list, b: list, most: int) -> int | None:
    """Edits (insert, delete, replace a word) from a to b if at most ``most``, else None. The words that both begin and end with need no
    alignment; the rest is aligned in a narrow band, which is doubled until it holds the edits or ``most``."""
    shorter = min(len(a), len(b))
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), shorter)
    e = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if i == shorter - k or x != y), shorter - k)
    a, b = a[k : len(a) - e], b[k : len(b) - e]
    if abs(len(a) - len(b)) > most:
        return None
    if not a or not b:
        return len(a) + len(b)
    band = max(FIRST_BAND, abs(len(a) - len(b)))
    while (d := aligned(a, b, min(band, most))) is None and band < most:
        band *= 2
    return d


def aligned(a: list, b: list, most: int) -> int | None:
    """Edits from a to b if at most ``most``, else None: an alignment within a band of 2 * most + 1 diagonals, a column of
    which is the bits of one number."""
    m, n = len(a), len(b)
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    band = (1 << (2 * most + 1)) - 1
    up, down, d = band >> most << most, 0, min(most, m)
    for j in range(1, n + 1):
        s = j - most - 1
        same = at.get(b[j - 1], 0)
        same = (same >> s if s >= 0 else same << -s) & band
        zero = ((((same & up) + up) ^ up) | same | down) & band
        right, left = (down | ~(zero | up)) & band, zero & up
        if j + most <= m:
            d += not zero >> 2 * most & 1
        else:
            bit = m - j + most
            if bit < 0:
                return None
            d += (right >> bit & 1) - (left >> bit & 1)
        up, down = (left | ~(zero >> 1 | right)) & band, zero >> 1 & right
    return d if d <= most else None


def similar(a: list, b: list, least: float = SIMILAR) -> bool:
    """Whether 1 - edits / words of the longer text is ``least`` or more."""
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    if abs(len(a) - len(b)) > most or longer - sum((Counter(a) & Counter(b)).values()) > most:
        return False
    return distance(a, b, most) is not None


def near_duplicates(docs: DataFrame, least: float = SIMILAR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: key, class_id, kept, links.

    class_id is the smallest id that links reach (equal texts are linked), kept is whether it is the row's own; links
    counts the verified links of the row's text with other texts (texts that links join already need none, so it is the
    number of those that made the class). Words stand
    between ASCII white space. A null text or one without words links with nothing, and a null id neither; such rows are their own class and are kept. Rows that share an id have one class. Other
    columns are left out.
    """
    picked = docs.select(F.col(key).alias("__id"), F.col(text).alias("__text")).withColumn("__hash", F.md5(F.col("__text").cast("binary")))
    kind = picked.schema["__id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", 1 << 21):
            rows, found = sketches(*utf8(batch.column("__text")))
            lists: list = [None] * batch.num_rows
            for i, s in zip(rows.tolist(), found):
                lists[i] = s
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__hash"), pa.array(lists, pa.list_(pa.int64()))], ["__id", "__hash", "sketch"])

    base = cut(picked.mapInArrow(sketch, f"__id {kind}, __hash string, sketch array<long>"), "sketches")
    usable = base.where("sketch is not null and __id is not null")
    leads = cut(usable.groupBy("__hash").agg(F.min("__id").alias("rep")), "text-classes")
    held = usable.join(leads, (usable["__hash"] == leads["__hash"]) & (usable["__id"] == leads["rep"])).select("rep", "sketch").dropDuplicates(["rep"])
    held = cut(held, "sketches-held")
    rows = held.select("rep", F.posexplode("sketch").alias("j", "bucket")).select("rep", "j", F.xxhash64("j", "bucket").alias("bucket"))

    def shared(rows: DataFrame) -> DataFrame:
        """Rows of buckets with two texts or more, with the bucket's first text."""
        first = rows.groupBy("bucket").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead <> last").select("bucket", "lead")
        return rows.join(first, "bucket").where("rep <> lead")

    level = cut(shared(rows), "buckets")
    ids = level.select("rep").unionByName(level.select(F.col("lead").alias("rep"))).distinct()
    ids = ids.join(leads.withColumnRenamed("__hash", "hash"), "rep")
    texts = picked.join(ids, (F.col("__id") == F.col("rep")) & (F.col("__hash") == F.col("hash"))).select("rep", F.col("__text").cast("binary").alias("__text")).dropDuplicates(["rep"])
    texts = cut(texts, "texts")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple = (None, [])
        for batch in batches:
            found = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                kept = kept if kept[0] == x else (x, x.split())
                found.append(similar(kept[1], y.split(), least))
            yield pa.RecordBatch.from_arrays([batch.column("lead"), batch.column("rep"), pa.array(found, pa.bool_())], ["lead", "rep", "same"])

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs, "pairs")
        # the text of a lead of many goes to as many tasks as its pairs need
        pairs = salted_join(pairs, texts.withColumnRenamed("__text", "x").withColumnRenamed("rep", "lead"), "lead", "rep", LEADS).join(texts.withColumnRenamed("__text", "y"), "rep")
        return cut(pairs.select("lead", "rep", "x", "y").mapInArrow(align, f"lead {kind}, rep {kind}, same boolean"), "aligned")

    # each text meets the first text of one of its buckets; what that joins needs no pairs of the others
    verified = verify(level.groupBy("rep").agg(F.min("lead").alias("lead")).select("lead", "rep"))
    groups = components(verified.where("same"), "lead", "rep")
    members = cut(level.select("bucket", "j", "rep").unionByName(level.select("bucket", "j", F.col("lead").alias("rep")).distinct()), "members")

    # members, each with its component, of the buckets that hold more than one
    named = members.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "j", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = named.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    members = cut(named.join(mixed, "bucket"), "unjoined")

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", 1 << 21):
            n, counts = profiles(*utf8(batch.column("__text")))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(n, pa.int64()), pa.array([c.tobytes() for c in counts], pa.binary()), batch.column("sketch"), batch.column("__text")], ["rep", "n", "counts", "sketch", "text"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "run", 1):
            edge = [0, *(np.flatnonzero(np.diff(table.column("run").to_numpy())) + 1).tolist(), table.num_rows]
            for a, b in zip(edge, edge[1:]):
                found = across(table.slice(a, b - a).combine_chunks())
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, table.schema.field("rep").type) for c in zip(*found)], ["lead", "rep"])

    def across(table: pa.Table) -> list[tuple]:
        """Links between the texts of two blocks of a bucket, or within one, that join the components there. A pair that shares
        several sketches is settled in the bucket of the first of them."""
        place, i, j = (table.column(c)[0].as_py() for c in ("place", "i", "j"))
        part, rep, n = (table.column(c).to_numpy() for c in ("part", "rep", "n"))
        group = np.unique(table.column("component").to_numpy(), return_inverse=True)[1].ravel()
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint8).reshape(-1, BINS)
        sketch = table.column("sketch").combine_chunks().flatten().to_numpy().reshape(len(n), -1)
        left, right = (np.flatnonzero(part == k) for k in (i, j))
        x, y = n[left][:, None], n[right][None, :]
        may = (group[left][:, None] != group[right][None, :]) & (np.abs(x - y) <= np.floor((1 - least) * np.maximum(x, y) + 1e-9))
        if i == j:
            may = np.triu(may)
        for k in range(place):
            may &= sketch[left, k][:, None] != sketch[right, k][None, :]
        s, t = np.nonzero(may)
        s, t = left[s], right[t]
        texts, words, out = table.column("text"), {}, []
        for c in range(0, len(s), 1 << 14):
            p, q = s[c : c + (1 << 14)], t[c : c + (1 << 14)]
            near = ~apart(n, counts, p, q, least)
            for u, v in zip(p[near].tolist(), q[near].tolist()):
                if group[u] == group[v]:
                    continue
                for w in (u, v):
                    if w not in words:
                        words[w] = texts[w].as_py().split()
                if similar(words[u], words[v], least):
                    out.append((rep[u], rep[v]))
                    group[group == group[v]] = group[u]
        return out

    if not members.isEmpty():
        own = held.join(members.select("rep").distinct(), "rep", "left_semi")
        told = cut(texts.join(own, "rep").select("rep", "sketch", "__text").mapInArrow(profile, f"rep {kind}, n long, counts binary, sketch array<long>, text binary"), "profiles")
        # a component that fills blocks of its own needs no pairs of them: they meet those of the rest, and these each other
        each = members.join(told.select("rep", "n"), "rep").groupBy("bucket", "component").agg(F.count("*").alias("texts"), F.sum("n").alias("words"))
        blocks = lambda x: F.greatest(F.ceil(x["texts"] / GROUP), F.ceil(x["words"] / WORDS)).cast("int")
        sums = each.groupBy("bucket").agg(F.max(F.struct("texts", "words", "component")).alias("main"), F.struct(F.sum("texts").alias("texts"), F.sum("words").alias("words")).alias("all"))
        rest = F.struct((F.col("all.texts") - F.col("main.texts")).alias("texts"), (F.col("all.words") - F.col("main.words")).alias("words"))
        large = blocks(F.col("main")) > 1
        sums = sums.select("bucket", F.when(large, F.col("main.component")).alias("main"), F.when(large, blocks(F.col("main"))).otherwise(0).alias("mains"), F.when(large, blocks(rest)).otherwise(blocks(F.col("all"))).alias("rests"))
        sized = members.join(sums, "bucket").withColumn("is_main", F.coalesce(F.col("component") == F.col("main"), F.lit(False)))
        number = F.xxhash64("rep")
        sized = sized.withColumn("part", F.when(F.col("is_main"), F.col("rests") + F.pmod(number, F.col("mains"))).otherwise(F.pmod(number, F.col("rests"))).cast("int"))
        # pairs of blocks: (i, j) for i <= j, each holding both blocks
        mates = F.sequence(F.lit(0), F.when(F.col("is_main"), F.col("rests")).otherwise(F.col("rests") + F.col("mains")) - 1)
        dealt = sized.withColumn("mate", F.explode(mates)).select("bucket", F.col("j").alias("place"), F.least("part", "mate").alias("i"), F.greatest("part", "mate").alias("j"), "part", "rep", "component")
        dealt = dealt.join(told, "rep").withColumn("run", F.xxhash64("bucket", "i", "j")).repartition("run").sortWithinPartitions("run", "bucket", "i", "j")
        new = cut(dealt.mapInArrow(meet, f"lead {kind}, rep {kind}"), "new-links")
        verified = verified.unionByName(new.withColumn("same", F.lit(True)))
        groups = components(groups.select(F.col("component").alias("lead"), F.col("node").alias("rep")).unionByName(new), "lead", "rep")
    links = verified.where("same")
    groups = groups.withColumnRenamed("node", "rep")
    ends = links.select("rep").unionByName(links.select(F.col("lead").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    told = leads.join(groups, "rep", "left").join(ends, "rep", "left").select(F.col("__hash"), F.coalesce("component", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    rows = base.drop("sketch")  # rows without a text have no hash to be joined by
    out = rows.where("__hash IS NOT NULL").join(told, "__hash", "left")
    out = out.unionByName(rows.where("__hash IS NULL").withColumns({"class_id": F.lit(None).cast(kind), "links": F.lit(0).cast("long")}))
    own = F.when(F.col("__id").isNull(), F.lit(None)).otherwise(F.coalesce("class_id", "__id"))
    return out.select(F.col("__id").alias(key), own.alias("class_id"), (F.col("__id").eqNullSafe(own)).alias("kept"), F.when(F.col("__id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("links"))
