"""Scoring texts by context-tree weighting, beside a plain unigram score of their words.

A text is coded byte by byte, and each byte as eight binary decisions. A decision's contexts are none and the last one
to DEPTH bytes; each context has a Krichevsky-Trofimov estimate of each decision, and the weighting mixes those of all
depths by how well each has coded the training texts: P(s) = 1/2 KT(s) + 1/2 product of P of the contexts longer by one
byte. A text's score is the log of P of training texts and text over P of the training texts, decision by decision, with
the training texts' counts.

Every context of the training texts is kept; the tree is a Spark table that grows with the corpus:

1. Texts are dealt out in blocks. A block's distinct places (context and byte) with their counts are one sorted array for
   each group of contexts, so that what is shuffled is as many arrays as blocks and groups, and no row for each place.
2. A group is a hash of a context's last STEM bytes, and so holds whole subtrees of at most 256^(DEPTH - STEM + 1) places
   each. A task adds up a group's arrays and weights its subtrees from the leaves up to STEM bytes. Of the contexts
   shorter than that the sums are a table of at most 65,536 contexts times 255 decisions; the driver weights it and it is
   broadcast.
3. Subtrees are weighted once more from the top down, which gives each place its log probability; a block's arrays get
   them in their own order, and go back to the block's texts.

Words are known by a 64-bit hash. A bounded number of the most frequent ones is broadcast; tokens of all others are
joined with their counts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, discard, fold, slices, utf8
from .tokens import byte_blocks

#: No UTF-8 text holds it: what stands before a text and ends it.
STOP = 255
#: Words whose counts are broadcast, at most.
FREQUENT = 1 << 17
#: Words that a worker holds before it passes their counts on, or remembers while it scores.
HELD = 200_000
WORD, PLACE, TEXTS = 0, 1, 2
#: Bytes of the longest context, and of those whose subtrees are weighted in tasks.
DEPTH, STEM = 5, 3
#: Groups of contexts by hash: so many for BLOCKS blocks, and with the root of the number of blocks more for more of them, so that neither groups nor
#: the arrays of a block and a group grow as the corpus does.
GROUPS, BLOCKS, FEWEST = 1024, 160, 64
#: Bytes of text of a block; a longer text is cut into blocks.
BLOCK_BYTES = 6 << 20
#: Places whose subtrees a task weights at once, at least.
AT_ONCE = 1 << 17
HALF = math.log(0.5)
NO_SPACE = ~np.isin(np.arange(256), [32, *range(9, 14)])


def _lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def _padded(data: np.ndarray, at: np.ndarray, leads: list[bytes | None] | None = None, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all lower-cased texts, each with DEPTH times STOP before and one after, which of these bytes are coded, where each
    text's coded bytes begin among those). A part of a text has the bytes before it in ``leads``, and its end is coded if it ``ends``."""
    n, size = len(at) - 1, np.diff(at)
    out = np.full(len(data) + (DEPTH + 1) * n, STOP, np.uint8)
    inside = np.arange(len(data)) + np.repeat((DEPTH + 1) * np.arange(n) + DEPTH, size)
    out[inside] = _lower(data)
    start = at[:-1] + (DEPTH + 1) * np.arange(n) + DEPTH
    for i, lead in enumerate(leads or ()):
        if lead:
            out[start[i] - len(lead) : start[i]] = _lower(np.frombuffer(lead, np.uint8))
    coded = np.zeros(len(out), bool)
    ends = np.ones(n, bool) if ends is None else ends
    coded[inside] = True
    coded[at[1:] + (DEPTH + 1) * np.arange(1, n + 1) - 1] = ends
    return out, coded, at + np.concatenate([[0], np.cumsum(ends)])


def places(data: np.ndarray, at: np.ndarray, leads: list[bytes | None] | None = None, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(for each coded byte its context, the last byte highest, then the byte itself; where each text's begin)."""
    out, coded, begin = _padded(data, at, leads, ends)
    code = np.zeros(max(0, len(out) - DEPTH), np.int64)
    for d in range(1, DEPTH + 1):
        code <<= 8
        code |= out[DEPTH - d : len(out) - d]
    code <<= 8
    code |= out[DEPTH:]
    return code[coded[DEPTH:]], begin


def group_of(code: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """The group of each place, by its last STEM bytes of context."""
    stem = (code >> 8 * (DEPTH - STEM + 1)).astype(np.uint64)
    part = (stem * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)
    return part.astype(np.uint16 if groups <= 1 << 16 else np.int64)


def groups_for(texts: DataFrame) -> int:
    """How many groups the contexts of these blocks are dealt out in."""
    return max(FEWEST, round(GROUPS * math.sqrt(texts.select("block").distinct().count() / BLOCKS)))


def shrink(x: np.ndarray) -> bytes:
    """Whole numbers as their bytes, all lowest ones first, so that those that are nought lie together."""
    return x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def swell(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()


def summed(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys in order, and sums of each of ``values`` for them."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return [key[first], *(np.add.reduceat(v[order], first) if len(key) else v for v in values)]


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after moving x up by eight."""
    x = np.asarray(x, np.float64)
    up = np.ones_like(x)
    for i in range(8):
        up *= x + i
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(up)


SMALL = 4096
_HALVES, _WHOLES = _log_gamma(np.arange(SMALL) + 0.5), _log_gamma(np.arange(2 * SMALL) + 1.0)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of any string of a zeros and b ones (whole numbers)."""
    low = (a < SMALL) & (b < SMALL)
    out = _HALVES[np.where(low, a, 0)] + _HALVES[np.where(low, b, 0)] - _WHOLES[np.where(low, a + b, 0)]
    if not low.all():
        x, y = a[~low].astype(np.float64), b[~low].astype(np.float64)
        out[~low] = _log_gamma(x + 0.5) + _log_gamma(y + 0.5) - _log_gamma(x + y + 1)
    return out - math.log(math.pi)


def _shorter(key: np.ndarray) -> np.ndarray:
    """Places with the context's first byte left out."""
    return key >> 16 << 8 | key & 255


class Subtrees:
    """Context trees of the places ``key`` (distinct, ascending, contexts of ``depth`` bytes) with counts ``n``, down from
    contexts of ``stem`` bytes."""

    def __init__(self, key: np.ndarray, n: np.ndarray, depth: int = DEPTH, stem: int = STEM):
        self.keys, self.ups, self.counts = [key], [], [n]
        for _ in range(depth - stem + (stem > 0)):  # the last level is that of the contexts above, where there are any
            short, back = np.unique(_shorter(self.keys[-1]), return_inverse=True)
            self.counts.append(np.bincount(back, self.counts[-1], len(short)).astype(np.int64) if len(back) else back)
            self.keys.append(short)
            self.ups.append(back)
        self.above = stem > 0

    def decision(self, bit: int) -> list[dict]:
        """For each level from the longest contexts up: name, a, b of the nodes of this decision, the node of each place,
        and each node's node in the next level."""
        out = []
        for key, n in zip(self.keys, self.counts):
            byte = key & 255
            name = key >> 8 << 8 | 1 << bit | byte >> (8 - bit)
            first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.zeros(0, np.int64)
            node = np.zeros(len(name), np.int64)
            node[first[1:]] = 1
            one = byte >> (7 - bit) & 1
            total = np.add.reduceat(n, first) if len(name) else n
            b = np.add.reduceat(n * one, first) if len(name) else n
            out.append({"name": name[first], "a": total - b, "b": b, "first": first, "node": np.cumsum(node), "one": one})
        for low, high, up in zip(out, out[1:], self.ups):
            low["parent"] = high["node"][up[low["first"]]]
        return out

    def weigh(self, bit: int, leaves: np.ndarray | None = None) -> list[dict]:
        """The same with the log of P in ``whole`` and how much of it is a node's own estimate in ``stay``. ``leaves``: log of P of the
        longest contexts' children, where these are weighted elsewhere."""
        levels = self.decision(bit)
        own = levels[:-1] if self.above else levels
        for i, x in enumerate(own):
            below = leaves if i == 0 else np.bincount(own[i - 1]["parent"], own[i - 1]["whole"], len(x["a"]))
            estimate = log_kt(x["a"], x["b"])
            x["whole"] = estimate if below is None else np.logaddexp(HALF + estimate, HALF + below)
            x["stay"] = np.ones(len(estimate)) if below is None else np.exp(np.minimum(0.0, HALF + estimate - x["whole"]))
        return levels

    def mixed(self, levels: list[dict], prior: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability of zero, of one, what is left for longer contexts) of the nodes of the longest contexts. ``prior``: the same
        of the level above."""
        own = levels[:-1] if self.above else levels
        zero, one, left = prior if prior else (np.zeros(1), np.zeros(1), np.ones(1))
        for x in reversed(own):
            if "parent" in x:
                zero, one, left = zero[x["parent"]], one[x["parent"]], left[x["parent"]]
            n = x["a"] + x["b"] + 1.0
            zero, one, left = zero + left * x["stay"] * (x["a"] + 0.5) / n, one + left * x["stay"] * (x["b"] + 0.5) / n, left * (1 - x["stay"])
        return zero, one, left


class Top:
    """The contexts shorter than STEM: what they predict, and what they leave to longer ones.

    ``name``, ``a``, ``b``, ``below``: of each decision's nodes in contexts of STEM - 1 bytes, the counts and the sum of
    the logs of P of the contexts longer by one byte. Held whole: at most 256^(STEM - 1) contexts times 255 decisions.
    """

    def __init__(self, name: np.ndarray, a: np.ndarray, b: np.ndarray, below: np.ndarray):
        order = np.argsort(name)
        name, a, b, below = (v[order] for v in (name, a, b, below))
        self.name = name
        self.zero, self.one, self.left = (np.zeros(len(name)) for _ in range(3))
        node = name & 255
        for bit in range(8):
            rows = np.flatnonzero(node >> bit == 1)
            if len(rows):
                # a node's two outcomes as two places, so that Subtrees sees the counts of each
                prefix = (node[rows] - (1 << bit)) << (8 - bit)
                key = np.repeat(name[rows] >> 8 << 8 | prefix, 2)
                key[1::2] |= 128 >> bit
                n = np.stack([a[rows], b[rows]], axis=1).ravel()
                trees = Subtrees(key, n, STEM - 1, 0)
                levels = trees.weigh(bit, below[rows])
                self.zero[rows], self.one[rows], self.left[rows] = trees.mixed(levels, None)

    def prior(self, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.searchsorted(self.name, name)
        return self.zero[at], self.one[at], self.left[at]


def pieces(key: np.ndarray, size: int) -> list[slice]:
    """Slices of about ``size`` places that keep each subtree whole."""
    if not len(key):
        return []
    stem = key >> 8 * (DEPTH - STEM + 1)
    edges = [0]
    while edges[-1] < len(key):
        to = min(len(key), edges[-1] + size)
        edges.append(len(key) if to == len(key) else int(np.searchsorted(stem, stem[to - 1], "right")))
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def roots(key: np.ndarray, n: np.ndarray, at_once: int = AT_ONCE) -> list[np.ndarray]:
    """name, a, b, below as ``Top`` takes them, of the places of whole subtrees."""
    found = []
    for some in pieces(key, at_once):
        trees = Subtrees(key[some], n[some])
        for bit in range(8):
            levels = trees.weigh(bit)
            stem, above = levels[-2], levels[-1]
            found.append((above["name"], above["a"], above["b"], np.bincount(stem["parent"], stem["whole"], len(above["a"]))))
    return summed(*map(np.concatenate, zip(*found))) if found else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]


def log_probabilities(key: np.ndarray, n: np.ndarray, top: Top, at_once: int = AT_ONCE) -> np.ndarray:
    """log10 probability of each place's byte in its context."""
    out = np.zeros(len(key))
    for some in pieces(key, at_once):
        trees = Subtrees(key[some], n[some])
        for bit in range(8):
            levels = trees.weigh(bit)
            zero, one, _ = trees.mixed(levels, top.prior(levels[-1]["name"]))
            node, is_one = levels[0]["node"], levels[0]["one"]
            out[some] += np.log10(np.where(is_one, one[node], zero[node]))
    return out


def threshold(counts: DataFrame, most: int):
    """The least n with at most about ``most`` rows at or above it (never more), from how many rows have each rounded n."""
    size = F.floor(F.log2("n") * 16)
    often = counts.groupBy(size.alias("size")).agg(F.count("*").alias("k"), F.min("n").alias("n")).orderBy(F.desc("size")).collect()
    least = 1 << 62
    for r in often:
        most -= r["k"]
        if most < 0:
            break
        least = r["n"]
    return F.lit(least)


def _word_hash(word: bytes) -> int:
    import xxhash

    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def blocks(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` with ``row``, ``block``, ``whole``, ``lead`` and ``ends``: consecutive rows of a task with about BLOCK_BYTES of ``text`` each. A longer
    text is several rows, cut between words, with the last bytes before it in ``lead``; ``whole`` is the row of its beginning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        row, block, held = first, first, 0
        for batch in slices(batches, "text", min(1 << 20, BLOCK_BYTES)):
            data, at = utf8(batch.column("text"))
            whole = row
            pieces = [data] if len(data) <= BLOCK_BYTES else list(byte_blocks(data, BLOCK_BYTES, NO_SPACE))
            lead = None
            for k, piece in enumerate(pieces):
                if held and held + len(piece) > BLOCK_BYTES:
                    block, held = row, 0
                held += len(piece)
                n, columns = batch.num_rows, list(batch.columns)
                if len(pieces) > 1:  # one long text
                    offsets = np.array([0, len(piece)], np.int32)
                    columns[batch.schema.names.index("text")] = pa.StringArray.from_buffers(1, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(piece)))
                rows = np.arange(row, row + n)
                own = [pa.array(rows), pa.array(np.full(n, block)), pa.array(np.full(n, whole) if len(pieces) > 1 else rows), pa.array([lead] * n, pa.binary()), pa.array([k == len(pieces) - 1] * n)]
                yield pa.RecordBatch.from_arrays([*columns, *own], [*batch.schema.names, "row", "block", "whole", "lead", "ends"])
                row += n
                lead = piece[-DEPTH:].tobytes()

    more = T.StructType.fromDDL("row long, block long, whole long, lead binary, ends boolean")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more.fields]))


def whole_blocks(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.Table]:
    """Runs of rows with one ``by``, which may go on from one batch to the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        name = batch.column(by).to_numpy()
        edges = [0, *(np.flatnonzero(name[1:] != name[:-1]) + 1).tolist(), len(name)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if held and held[0].column(by)[0].as_py() != name[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def count(texts: DataFrame, groups: int = GROUPS) -> DataFrame:
    """kind, key, n, block, keys, counts: occurrences in training texts of words by hash (WORD) and of ends (TEXTS); for each
    block and group (key) the distinct places of all texts, and how often each stands in training texts (PLACE). A block
    that two tasks read is two parts; n is a part's first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def rows(kind: int, key, n, block=None, keys=None, counts=None) -> pa.RecordBatch:
            some = len(key)
            columns = [np.full(some, kind, np.int32), pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array([block] * some, pa.int64()), pa.array(keys or [None] * some, pa.binary()), pa.array(counts or [None] * some, pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(columns[0]), *columns[1:]], ["kind", "key", "n", "block", "keys", "counts"])

        def told(code: list[np.ndarray], block: int, row: int) -> Iterator[pa.RecordBatch]:
            flagged = np.sort(np.concatenate(code))
            key = flagged >> 1
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key, n = key[first], np.add.reduceat(flagged & 1, first)
            group = group_of(key, groups)
            order = np.argsort(group, kind="stable")
            key, n, group = key[order], n[order], group[order]
            edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            ends = [*edge[1:].tolist(), len(key)]
            keys = [shrink(np.diff(key[a:b], prepend=0)) for a, b in zip(edge.tolist(), ends)]
            counts = [shrink(n[a:b]) for a, b in zip(edge.tolist(), ends)]
            yield rows(PLACE, group[edge].astype(np.int64), np.full(len(edge), row), block, keys, counts)

        held, block, row, ends = [], None, 0, 0
        for batch in slices(batches, "text", 1 << 20):
            name = batch.column("block").to_numpy()
            for here in np.unique(name):
                part = batch.filter(pa.array(name == here)) if name[0] != name[-1] else batch
                if held and here != block:
                    yield from told(held, block, row)
                    held = []
                if not held:
                    block, row = int(here), part.column("row")[0].as_py()
                trains = ~part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                data, at = utf8(part.column("text"))
                last = part.column("ends").to_numpy(zero_copy_only=False).astype(bool)
                code, begin = places(data, at, part.column("lead").to_pylist(), last)
                held.append(code << 1 | np.repeat(trains, np.diff(begin)))
                ends += int((trains & last).sum())
                raw = data.tobytes()
                words.update(b" ".join([raw[at[i] : at[i + 1]] for i in np.flatnonzero(trains)]).lower().split())
                if len(words) > HELD:
                    yield rows(WORD, [_word_hash(w) for w in words], list(words.values()))
                    words.clear()
        if held:
            yield from told(held, block, row)
        yield rows(WORD, [_word_hash(w) for w in words], list(words.values()))
        yield rows(TEXTS, [0], [ends])

    return texts.select("row", "block", "held_out", "text", "lead", "ends").mapInArrow(run, "kind int, key long, n long, block long, keys binary, counts binary")


def gathered(found: DataFrame) -> DataFrame:
    """name, a, b, below, grp, keys, counts: a row with all places of each group, and sums for the contexts above from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["name", "a", "b", "below", "grp", "keys", "counts"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.binary(), pa.binary()]
        above: list[np.ndarray] | None = None
        for table in whole_blocks(batches, "key"):
            key, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k, c in zip(table.column("keys"), table.column("counts")):
                key.append(np.cumsum(swell(k.as_py())))
                n.append(swell(c.as_py()))
                if sum(map(len, key[1:])) > max(1 << 21, 2 * len(key[0])):
                    key, n = ([v] for v in summed(np.concatenate(key), np.concatenate(n)))
            key, n = summed(np.concatenate(key), np.concatenate(n))
            own = roots(key, n)
            above = own if above is None else summed(*(np.concatenate(pair) for pair in zip(above, own)))
            row = [[None], [None], [None], [None], [table.column("key")[0].as_py()], [shrink(np.diff(key, prepend=0))], [shrink(n)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types)], names)
        if above is not None:
            empty = [None] * len(above[0])
            yield pa.RecordBatch.from_arrays([*map(pa.array, above), *(pa.array(empty, t) for t in types[4:])], names)

    dealt = found.where(F.col("kind") == PLACE).select("key", "keys", "counts").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "name long, a long, b long, below double, grp long, keys binary, counts binary")


def weighted(found: DataFrame, groups: DataFrame, top) -> DataFrame:
    """block, row, key, logs: for each part of a block and each group the log10 probabilities of its places, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, key, logs = None, None, None
        for batch in batches:
            block, row, told, out = [], [], [], []
            for r in batch.to_pylist():
                if r["block"] is None:  # the group's places come before its blocks
                    group, key = r["key"], np.cumsum(swell(r["keys"]))
                    logs = log_probabilities(key, swell(r["counts"]), top.value).astype(np.float32)
                    continue
                if r["key"] != group:
                    raise RuntimeError(f"no places of group {r['key']}")
                block.append(r["block"])
                row.append(r["n"])
                told.append(group)
                out.append(logs[np.searchsorted(key, np.cumsum(swell(r["keys"])))].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(row, pa.int64()), pa.array(told, pa.int64()), pa.array(out, pa.binary())], ["block", "row", "key", "logs"])

    asked = found.where(F.col("kind") == PLACE).select("key", "block", "n", "keys", F.lit(None).cast("binary").alias("counts"))
    model = groups.where("grp is not null").select(F.col("grp").alias("key"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("long").alias("n"), "keys", "counts")
    dealt = model.unionByName(asked).repartition("key").sortWithinPartitions("key", F.asc_nulls_first("block"))
    return dealt.mapInArrow(run, "block long, row long, key long, logs binary")


def score_block(data: np.ndarray, at: np.ndarray, logs: list[bytes], leads: list[bytes | None] | None = None, ends: np.ndarray | None = None, groups: int = GROUPS) -> np.ndarray:
    """log10 probability of each text with its end; ``logs`` are the arrays of ``weighted`` for just these texts, by group."""
    code, begin = places(data, at, leads, ends)
    order = np.argsort(code)
    code = code[order]
    new = np.concatenate([[True], code[1:] != code[:-1]])
    distinct = code[new]
    value = np.empty(len(distinct))
    value[np.argsort(group_of(distinct, groups), kind="stable")] = np.frombuffer(b"".join(logs), np.float32)
    each = np.empty(len(code))
    each[order] = value[np.cumsum(new) - 1]
    return np.add.reduceat(each, begin[:-1])


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Texts whose crc32 of the id as text is 1 modulo 5 are held out; all others train. A null text is empty; a null id
    isn't held out. A text's tokens are its words and one end. ``score`` is the log10 probability of the lower-cased
    text's bytes and their end by the context trees, ``base_score`` that of its tokens by add-half unigram counts.
    Without training texts every decision is even. Repeated rows are scored each for itself, other columns are left out.
    A text above BLOCK_BYTES is scored in parts, each with the bytes before it as its first contexts.
    """
    held = F.coalesce(fold(F.col(key)) == 1, F.lit(False))
    picked = docs.select(F.col(key).alias("__key"), held.alias("held_out"), F.col(text).alias("text"))
    texts = cut(blocks(picked), "ctw-texts", free=True)
    groups_n = groups_for(texts)
    found = cut(count(texts, groups_n), "ctw-counts", free=True)
    spark = docs.sparkSession

    words = cut(found.where(F.col("kind") == WORD).groupBy("key").agg(F.sum("n").alias("n")), "ctw-words", free=True)
    n_texts = found.where(F.col("kind") == TEXTS).agg(F.sum("n")).first()[0] or 0
    n_words, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, kinds = n_words + n_texts, distinct + (n_texts > 0)
    of: Callable[[int], float] = lambda c: math.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))
    least = threshold(words, FREQUENT)
    frequent = words.where(F.col("n") >= least).toPandas()

    groups = cut(gathered(found), "ctw-groups", free=True)
    above = groups.where("name is not null").groupBy("name").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("below").alias("below")).toPandas()
    top = spark.sparkContext.broadcast(Top(*(above[c].to_numpy() for c in ("name", "a", "b", "below"))))
    shared = spark.sparkContext.broadcast((frequent.key.to_numpy(), frequent.n.to_numpy()))
    end, even = of(n_texts), n_texts == 0

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        value = dict(zip(shared.value[0].tolist(), shared.value[1].tolist()))
        left, right = left.sort_by("row"), right.sort_by([("row", "ascending"), ("key", "ascending")])
        data, at = utf8(left.column("text"))
        first, part = np.unique(right.column("row").to_numpy(), return_index=True)
        logs = [right.column("logs").slice(a, b - a).to_pylist() for a, b in zip(part, [*part[1:], right.num_rows])]
        edge = [*np.searchsorted(left.column("row").to_numpy(), first), left.num_rows]
        leads, ends = left.column("lead").to_pylist(), left.column("ends").to_numpy(zero_copy_only=False).astype(bool)
        scores = np.concatenate([score_block(data[at[a] : at[b]], at[a : b + 1] - at[a], x, leads[a:b], ends[a:b], groups_n) for a, b, x in zip(edge, edge[1:], logs)])
        raw, tokens, known, base, rare = data.tobytes().lower(), [], [], [], []
        seen: dict[bytes, float | int] = {}
        for a, b, last in zip(at[:-1].tolist(), at[1:].tolist(), ends.tolist()):
            words, here, s = raw[a:b].split(), [], end if last else 0.0
            for w in words:
                v = seen.get(w)
                if v is None:
                    h = _word_hash(w)
                    n = value.get(h)
                    v = h if n is None else of(n)
                    if len(seen) >= HELD:
                        seen.clear()
                    seen[w] = v
                if v.__class__ is float:
                    s += v
                else:
                    here.append(v)
            tokens.append(len(words) + last)
            known.append(len(words) - len(here) + (last and not even))
            base.append(s)
            rare.append(here)
        columns = [left.column("whole"), left.column("__key"), left.column("held_out"), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores), pa.array(np.diff(at).astype(np.int64)), pa.array(rare, pa.list_(pa.int64()))]
        return pa.Table.from_arrays(columns, ["whole", "__key", "held_out", "n_tokens", "known", "base", "score", "n_bytes", "rare"])

    kind = texts.schema["__key"].dataType.simpleString()
    logs = cut(weighted(found, groups, top), "ctw-logs", free=True)
    discard(found, groups)  # what was made of them is written
    both = texts.groupBy("block").cogroup(logs.groupBy("block"))
    scored = cut(both.applyInArrow(run, f"whole long, __key {kind}, held_out boolean, n_tokens long, known long, base double, score double, n_bytes long, rare array<long>"), "ctw-scored", free=True)
    top.destroy(), shared.destroy()  # their only readers are written
    discard(texts, logs)
    rest = scored.select("whole", F.explode("rare").alias("key")).join(words.where(F.col("n") < least), "key", "left")
    log = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(total + 0.5 * (kinds + 1)))
    rest = rest.groupBy("whole").agg(F.sum(log).alias("more"), F.count("n").alias("more_known"))
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "known", "base", "score", "n_bytes")]
    scored = scored.groupBy("whole").agg(F.first("__key").alias("__key"), F.first("held_out").alias("held_out"), *sums)
    return scored.join(rest, "whole", "left").select(
        F.col("__key").alias(key),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
        (-F.col("score") * math.log2(10) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
