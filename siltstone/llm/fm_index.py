"""Benchmark decontamination by an FM-index of each training shard.

A shard is some megabytes of whole documents as a sequence of word numbers, each document ended by a mark. Its index has
the Burrows-Wheeler transform of that sequence as a wavelet matrix, the number of smaller symbols for each, and the
places of sampled suffixes: each document's first word and every SAMPLE-th after it. A phrase is searched from its last word
to its first, which narrows a range of suffixes by two ranks a word; where its suffixes stand is found by steps back to a
sampled one. Shards are rows of a table, which can be kept and searched for other phrases later.

Suffixes are sorted whole: by numbers of a few words first, then by doubling within what is still tied. Marks differ from
each other, so no tie goes beyond a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, utf8
from .tokens import byte_blocks, coded, split_bytes, split_words, words

#: Consecutive words of an item that are looked for.
WINDOW = 10
#: Bytes of text of a shard; a longer text is cut into shards that overlap by a window less a word.
SHARD_BYTES = 8 << 20
#: Words from one sampled suffix of a document to the next.
SAMPLE = 16
#: Bytes of windows that are sent to all shards at once; more of them go in several rounds.
ROUND_BYTES = 32 << 20
SHARD = "part int, row binary, key binary, no_key binary, first binary, fresh binary, start binary, terms binary, term_at binary, smaller binary, levels binary, marks binary, sampled binary"
NUMBERS = {"row": np.int64, "key": np.int64, "no_key": bool, "first": np.int64, "fresh": np.int64, "start": np.int64, "term_at": np.int64, "smaller": np.int64, "levels": np.uint64, "marks": np.uint64, "sampled": np.int32}


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The places of all suffixes in their order. The last symbol, and any other that ends ties, must be there once only."""
    n = len(symbols)
    bits = max(1, int(symbols.max(initial=0)).bit_length())
    step = min(63 // bits, n)
    number = np.zeros(n, np.int64)
    for i in range(step):
        number = number << bits
        number[: n - i] |= symbols[i:]
    order = np.argsort(number)
    first = np.ones(n, bool)
    first[1:] = number[order[1:]] != number[order[:-1]]
    begin = np.flatnonzero(first)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(begin, np.diff(np.append(begin, n)))
    size = np.diff(np.append(begin, n))
    tied = np.repeat(size > 1, size)
    slots = np.flatnonzero(tied)
    while len(slots):
        places = order[slots]
        mine = rank[places]
        key = mine * (n + 1) + rank[np.minimum(places + step, n - 1)]
        by = np.argsort(key)
        places, key, mine = places[by], key[by], mine[by]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(key)))
        rank[places] = np.repeat(slots[begin], size)
        order[slots] = places
        slots = slots[np.repeat(size > 1, size)]
        step *= 2
    return order


class Bits:
    """Rows of bits with the number of ones before any place of each."""

    def __init__(self, packed: np.ndarray):
        self.packed = packed
        self.before = np.zeros((len(packed), packed.shape[1] + 1), np.int32)
        np.cumsum(np.bitwise_count(packed), axis=1, out=self.before[:, 1:])

    @staticmethod
    def pack(bits: np.ndarray) -> np.ndarray:
        """Bits as 64-bit words, with a word of zeros after the last."""
        held = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        held[: len(packed)] = packed
        return held.view(np.uint64)

    def get(self, level: int, i: np.ndarray) -> np.ndarray:
        return (self.packed[level, i >> 6] >> (i & 63).astype(np.uint64)).astype(np.int64) & 1

    def rank(self, level: int, i: np.ndarray) -> np.ndarray:
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level, i >> 6] + np.bitwise_count(self.packed[level, i >> 6] & below).astype(np.int64)


class Wavelet:
    """Ranks of symbols in a sequence: a level of bits for each binary digit, in which zeros come before ones at the next."""

    def __init__(self, levels: np.ndarray, n: int, smaller: np.ndarray):
        self.bits, self.depth, self.n = Bits(levels), len(levels), n
        self.zeros = n - self.bits.before[:, -1].astype(np.int64)
        # where each symbol begins in the order of the last level, which is that of the digits read backwards
        count = np.diff(smaller)
        backward = np.zeros(len(count), np.int64)
        for b in range(self.depth):
            backward |= (np.arange(len(count)) >> b & 1) << (self.depth - 1 - b)
        order = np.argsort(backward)
        self.begin = np.empty(len(count), np.int64)
        self.begin[order] = np.cumsum(count[order]) - count[order]

    @staticmethod
    def levels(sequence: np.ndarray, symbols: int) -> np.ndarray:
        out = []
        for b in range(max(1, (symbols - 1).bit_length()) - 1, -1, -1):
            ones = (sequence >> b & 1).astype(bool)
            out.append(Bits.pack(ones))
            sequence = np.concatenate([sequence[~ones], sequence[ones]])
        return np.stack(out)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place i."""
        for level in range(self.depth):
            ones = self.bits.rank(level, i)
            one = symbol >> (self.depth - 1 - level) & 1
            i = np.where(one, self.zeros[level] + ones, i - ones)
        return i - self.begin[symbol]

    def step(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before."""
        symbol = np.zeros(len(i), np.int64)
        for level in range(self.depth):
            ones, one = self.bits.rank(level, i), self.bits.get(level, i)
            symbol = symbol << 1 | one
            i = np.where(one, self.zeros[level] + ones, i - ones)
        return symbol, i - self.begin[symbol]


class Shard:
    """An index read back from its row."""

    def __init__(self, row: dict):
        for name, kind in NUMBERS.items():
            setattr(self, name, np.frombuffer(row[name], kind))
        self.n = int(self.smaller[-1])
        self.wavelet = Wavelet(self.levels.reshape(-1, self.n // 64 + 1), self.n, self.smaller)
        self.sampled_rows = Bits(self.marks.reshape(1, -1))
        self.terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.term_at) - 1, [None, pa.py_buffer(row["term_at"]), pa.py_buffer(row["terms"])])

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each phrase; a row of symbols each, all of one length and all in the shard."""
        low, high = self.smaller[phrases[:, -1]], self.smaller[phrases[:, -1] + 1]
        for j in range(phrases.shape[1] - 2, -1, -1):
            left = np.flatnonzero(low < high)
            symbol = phrases[left, j]
            ends = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low[left], high[left]]))
            low[left] = self.smaller[symbol] + ends[: len(left)]
            high[left] = self.smaller[symbol] + ends[len(left) :]
        return low, high

    def locate(self, i: np.ndarray) -> np.ndarray:
        """Where the suffixes of these ranks stand: all of them must begin with a word."""
        out, steps, open_ = np.empty(len(i), np.int64), 0, np.arange(len(i))
        while len(open_):
            known = self.sampled_rows.get(0, i) == 1
            out[open_[known]] = self.sampled[self.sampled_rows.rank(0, i[known])] + steps
            open_, i = open_[~known], i[~known]
            if len(i):
                symbol, before = self.wavelet.step(i)
                i = self.smaller[symbol] + before
            steps += 1
        return out


def index_row(found: pa.LargeBinaryArray, at: np.ndarray, row: np.ndarray, key: pa.Array, first: np.ndarray, fresh: np.ndarray) -> dict:
    """The index of documents, whose words are those from at[i] to at[i + 1]: ``first`` is the number of a document's words before
    this shard, ``fresh`` how many here no earlier shard has."""
    code, terms = coded(found)
    docs, size = len(at) - 1, np.diff(at)
    start = at[:-1] + np.arange(docs)  # in the sequence, where each document has its mark after it
    n = len(code) + docs
    mark = start + size
    doc = np.repeat(np.arange(docs), size)
    place = np.arange(len(code)) + doc
    symbols = np.empty(n, np.int64)
    symbols[mark] = np.arange(docs)
    symbols[place] = code + docs
    order = suffix_order(symbols)
    symbols = np.maximum(symbols - docs + 1, 0)  # all marks are one symbol to the transform
    smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=len(terms) + 1))])
    sample = np.zeros(n, bool)
    sample[place] = (place - start[doc]) % SAMPLE == 0
    marks = sample[order]
    held = terms.buffers()
    return {
        "row": row.astype(np.int64),
        "key": pc.fill_null(key.cast(pa.int64()), 0).to_numpy(zero_copy_only=False),
        "no_key": pc.is_null(key).to_numpy(zero_copy_only=False),
        "first": first.astype(np.int64),
        "fresh": fresh.astype(np.int64),
        "start": start.astype(np.int64),
        "terms": held[2].to_pybytes() if held[2] is not None else b"",
        "term_at": np.frombuffer(held[1], np.int64)[terms.offset : terms.offset + len(terms) + 1] if len(terms) else np.zeros(1, np.int64),
        "smaller": smaller.astype(np.int64),
        "levels": Wavelet.levels(symbols[order - 1], len(terms) + 1),
        "marks": Bits.pack(marks),
        "sampled": order[marks].astype(np.int32),
    }


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", longest: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A table of shards of all rows of ``docs``, in which phrases of up to ``longest`` words can be searched; ``part`` is 0 for all.

    Null and empty texts are documents without words; the key is a whole number or null; repeated rows are documents of their own.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in slices(batches, "text", shard_bytes):
            row, key = batch.column("row").to_numpy(), batch.column("key")
            data, at = utf8(batch.column("text"))
            if len(data) <= shard_bytes:
                found, at = split_words(batch.column("text"))
                yield index_row(found, at, row, key, np.zeros(len(row)), np.diff(at))
                continue
            tail, done = pa.array([], pa.large_binary()), 0  # one long text
            for block in byte_blocks(data, shard_bytes):
                fresh, _ = split_bytes(block, np.array([0, len(block)]))
                both = pa.concat_arrays([tail, fresh])
                yield index_row(both, np.array([0, len(both)]), row, key, np.array([done - len(tail)]), np.array([len(fresh)]))
                done += len(fresh)
                tail = both.slice(max(0, len(both) - longest + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in shards(batches):
            names = [c.split()[0] for c in SHARD.split(", ")][1:]
            cells = [r[c] if isinstance(r[c], bytes) else np.ascontiguousarray(r[c]).tobytes() for c in names]
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], ["part", *names])

    told = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return told.mapInArrow(run, SHARD)


def windows(items: DataFrame, size: int = WINDOW, key: str = "item_id", text: str = "text") -> DataFrame:
    """item, window: each run of ``size`` consecutive words of an item; one of fewer, but not none, is a window itself."""
    told = items.select(F.col(key).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))
    return told.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.lit(size)))).alias("window")).distinct()


def merged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of places that are covered by [low, high), each pair in the order of low."""
    reach = np.maximum.accumulate(high)
    new = np.ones(len(low), bool)
    new[1:] = low[1:] > reach[:-1]
    begin = np.flatnonzero(new)
    return low[begin], reach[np.append(begin[1:], len(low)) - 1] if len(low) else high


def _found(shard: Shard, items: np.ndarray, symbols: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place, window) of each occurrence of windows, whose words are given one after another."""
    code = pc.fill_null(pc.index_in(symbols, value_set=shard.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    ends = np.cumsum(sizes)
    known = np.minimum.reduceat(code, ends - sizes) > 0 if len(sizes) else np.zeros(0, bool)
    place, window = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in np.unique(sizes[known]):
        at = np.flatnonzero(known & (sizes == size))
        low, high = shard.search(code[(ends[at] - size)[:, None] + np.arange(size)])
        times = high - low
        suffix = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
        place.append(shard.locate(suffix))
        window.append(np.repeat(at, times))
    place, window = np.concatenate(place), np.concatenate(window)
    return np.searchsorted(shard.start, place, "right") - 1, place, window


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            shard = Shard({c: batch.column(c)[i].as_buffer() for c in [*NUMBERS, "terms"]})
            told = batch.column("windows")[i].values
            wanted, items = (told.field(c) for c in ("window", "item"))
            sizes = wanted.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            doc, place, window = _found(shard, items, wanted.flatten().cast(pa.large_binary()), sizes)
            order = np.lexsort((place, doc))
            doc, place, window = doc[order], place[order], window[order]
            low, high = merged(place, place + sizes[window])  # a mark stands between documents, so that runs don't meet
            of = np.searchsorted(shard.start, low, "right") - 1
            shift = shard.first - shard.start
            spans = pa.StructArray.from_arrays([pa.array(low + shift[of]), pa.array(high + shift[of])], ["start", "end"])
            pairs = np.unique(doc * max(1, len(items)) + window)
            held = items.take(pa.array(pairs % max(1, len(items))))
            ends = lambda docs: pa.array(np.searchsorted(docs, np.arange(len(shard.row) + 1)).astype(np.int32))
            columns = [
                pa.array(shard.row),
                pa.array(shard.key, mask=shard.no_key),
                pa.array(shard.fresh),
                pa.ListArray.from_arrays(ends(of), spans),
                pa.ListArray.from_arrays(ends(pairs // max(1, len(items))), held),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["row", "key", "n_words", "spans", "items"])


def search(shards: DataFrame, wanted: DataFrame, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """A row for each document of ``shards`` and its parts: row, key, n_words, spans (start, end in words), items.

    ``wanted``: what ``windows`` gives. It goes to all shards in rounds of about ``round_bytes``.
    """
    size = wanted.agg(F.sum(F.octet_length(F.array_join("window", " "))), F.count("*")).first()
    rounds = max(1, -(-((size[0] or 0) + 48 * size[1]) // round_bytes))
    if rounds > 1:
        wanted, shards = cut(wanted, "fm-windows"), cut(shards, "fm-shards")
    out = []
    for i in range(rounds):
        some = wanted.where(F.pmod(F.xxhash64("window"), F.lit(rounds)) == i).agg(F.collect_list(F.struct("window", "item")).alias("windows"), F.coalesce(F.min(F.size("window") * 0), F.lit(0)).alias("part"))
        pair = shards.join(F.broadcast(some), "part")  # one row of checked size
        found = pair.drop("part").mapInArrow(_search, "row long, key long, n_words long, spans array<struct<start:long,end:long>>, items array<string>")
        out.append(found if i == 0 else found.withColumn("n_words", F.lit(0).cast("long")))
    return reduce(DataFrame.unionByName, out)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", shard_bytes: int = SHARD_BYTES, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """A row for each row of ``docs``: key, n_words, n_hit, spans (runs of words to remove, by start and end), items.

    Null and empty texts have no words and no hits; rows of one item count as one item, and an item without an id hits words
    but isn't listed; repeated rows are searched each for itself; an empty table gives no rows; other columns are left out.
    """
    found = search(build(docs, key, text, window, shard_bytes), windows(items, window, item_key, item_text), round_bytes)
    whole = found.groupBy("row").agg(
        F.first("key").alias(key), F.sum("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter("items", lambda i: i.isNotNull()))))).alias("items")
    )
    return whole.select(key, "n_words", n_hit(F.col("spans")).alias("n_hit"), "spans", "items")


def n_hit(spans):
    """Words that spans, sorted by their starts, cover together."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))
    add = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["reach"]))).alias("n"), F.greatest(a["reach"], s["end"]).alias("reach"))
    return F.aggregate(spans, zero, add, lambda a: a["n"])


LEAK_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
s AS (SELECT item_id, w, unnest(range(0, greatest(1, len(w) - {WINDOW} + 1))) AS i FROM b WHERE len(w) > 0),
k AS (SELECT DISTINCT item_id, w[i + 1 : i + {WINDOW}] AS run, len(w[i + 1 : i + {WINDOW}]) AS size FROM s),
z AS (SELECT DISTINCT size FROM k),
p AS (SELECT r, size, i, w[i + 1 : i + size] AS run FROM (SELECT r, size, w, unnest(range(0, len(w) - size + 1)) AS i FROM d, z WHERE len(w) >= size)),
h AS (SELECT r, item_id, i, size FROM p JOIN k USING (size, run)),
n AS (SELECT r, count(DISTINCT word) AS n FROM (SELECT r, unnest(range(i, i + size)) AS word FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""
