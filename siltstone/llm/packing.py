"""Cost-balanced packing of documents into token sequences.

Each task packs the documents it reads in blocks of bounded size, so nothing is shuffled and a lost executor's tasks
give the same pieces when they are run again. Within a block a document costs ``linear * n + quadratic * n * n`` for
its attention; pieces are dealt out by falling cost, each to the sequence of the lowest cost that has room for it.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

CAPACITY = 2048
END_ID = 1
#: Tokens that a task packs at once, at least; what is held for them is about 20 MB.
BLOCK_TOKENS = 1 << 21
#: Words whose ids a worker remembers.
REMEMBERED = 200_000


class Ids:
    """Byte-level BPE ids of texts, as the ``tokenizers`` library gives them for ``json_path`` without any setting changed.

    The file's added tokens are single ids wherever they stand in a text; what is between them is encoded by the same ranks. Words between single
    spaces are independent of each other in this vocabulary's split pattern, so that the ids of frequent ones are
    remembered; a text with longer runs of space is encoded whole."""

    def __init__(self, tiktoken_path: str, pattern: str, json_path: str | None = None):
        import tiktoken

        with open(tiktoken_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}
        self.runs = re.compile(r" (?:\s|\Z)")
        self.added: dict[str, bytes] = {}
        if json_path:
            with open(json_path, encoding="utf-8") as f:
                self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in json.load(f)["added_tokens"]}
        longest = sorted(self.added, key=len, reverse=True)
        self.cuts = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None

    def _pack(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self.cuts is None or not self.cuts.search(text):
            return self.between(text)
        return b"".join(self.added[t] if t in self.added else self.between(t) for t in self.cuts.split(text))

    def between(self, text: str) -> bytes:
        if self.runs.search(text):
            return self._pack(text)
        first, *rest = text.split(" ")
        out = [self._pack(first)] if first else []
        known, add = self.known, out.append
        for word in rest:
            ids = known.get(word)
            if ids is None:
                ids = self._pack(" " + word)
                if len(word) <= 40:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = ids
            add(ids)
        return b"".join(out)


def room(total: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the sequences for ``total`` tokens: full ones, then powers of two for what is left, which need no padding."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(lengths: np.ndarray, capacity: int = CAPACITY, linear: float = 1.0, quadratic: float = 1.0 / CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that fill the sequences of ``room`` without a gap.

    Whole capacities of long documents are sequences of their own. The rest goes by falling cost to the sequence of the
    lowest cost with room for all of it; if there is none, the piece is cut to fill the one with the most room.
    """
    cost = lambda n: linear * n + quadratic * n * n
    total = int(lengths.sum())
    full, rest = lengths // capacity, lengths % capacity
    pieces, sequence = [], 0
    for d in np.flatnonzero(full):
        for k in range(int(full[d])):
            pieces.append((int(d), k * capacity, capacity, sequence, 0))
            sequence += 1
    free = np.array(room(total - sequence * capacity, capacity), np.int64)
    used, load = np.zeros(len(free), np.int64), np.zeros(len(free))
    heap = [(-int(rest[d]), int(d), int(full[d]) * capacity) for d in np.flatnonzero(rest)]
    heapq.heapify(heap)
    while heap:
        n, d, start = heapq.heappop(heap)
        n = -n
        fits = np.flatnonzero(free >= n)
        at = int(fits[np.argmin(load[fits])]) if len(fits) else int(np.argmax(free))
        m = min(n, int(free[at]))
        pieces.append((d, start, m, sequence + at, int(used[at])))
        free[at] -= m
        used[at] += m
        load[at] += cost(m)
        if m < n:
            heapq.heappush(heap, (m - n, d, start + m))
    return pieces


def pack_documents(docs: DataFrame, tokenizer: str | None = None, added: str | None = None, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its whole text (null: none), then the end id 1, so that each document has a piece.
    ``tokenizer`` and ``added``: paths, on every executor, of a rank file and of the same vocabulary's JSON file, which
    has its added tokens; ``public_tokenizers`` has the default ones, and a rank file alone has no added tokens. Repeated
    rows are packed each for itself, a null key stays null, other columns are left out. Sequence ids begin with the
    task's number, so that no two tasks share one.
    """
    SCHEMA = ["__key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers as public

        encode = Ids(tokenizer or public.path("byte_bpe_50k.tiktoken"), public.PATTERN, added or (None if tokenizer else public.path("byte_bpe_50k.json")))
        end, next_id = np.array([END_ID], "<u4").tobytes(), TaskContext.get().partitionId() << 40
        keys: list[pa.Array] = []
        ids: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal next_id, held
            lengths = np.array([len(x) // 4 for x in ids], np.int64)
            pieces = np.array(sorted(pack(lengths, capacity)), np.int64).reshape(-1, 5)
            crc = [zlib.crc32(memoryview(ids[d])[4 * s : 4 * (s + n)]) for d, s, n in pieces[:, :3].tolist()]
            key_column = pa.concat_arrays(keys).take(pa.array(pieces[:, 0]))
            columns = [pieces[:, 1], pieces[:, 2], np.array(crc, np.int64), lengths[pieces[:, 0]], pieces[:, 3] + next_id, pieces[:, 4]]
            next_id += int(pieces[:, 3].max()) + 1
            keys.clear(), ids.clear()
            held = 0
            return pa.RecordBatch.from_arrays([key_column, *map(pa.array, columns)], SCHEMA)

        for batch in slices(batches, "__text"):
            keys.append(batch.column("__key"))
            new = [encode(t or "") + end for t in batch.column("__text").to_pylist()]
            ids.extend(new)
            held += sum(map(len, new)) // 4
            if held >= BLOCK_TOKENS:
                yield flush()
        if ids:
            yield flush()

    picked = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    kind = picked.schema["__key"].dataType.simpleString()
    return picked.mapInArrow(run, f"__key {kind}, " + ", ".join(f"{c} long" for c in SCHEMA[1:])).withColumnRenamed("__key", key)
