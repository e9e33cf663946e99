"""Words of whole texts in numpy: runs of bytes of a class, with A-Z lower-cased; bytes above 127 always belong to words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import utf8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words of letters and digits, in a text whose A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_bytes(digits: bool = True) -> np.ndarray:
    """For each byte the byte of a word that it is, lower-cased, or 0 if it stands between words."""
    out = np.zeros(256, np.uint8)
    out[128:] = np.arange(128, 256)
    for c in LOWER:
        out[[ord(c), ord(c.upper())]] = ord(c)
    if digits:
        out[48:58] = np.arange(48, 58)
    return out


WORDS, LETTERS = word_bytes(), word_bytes(digits=False)


def split_bytes(data: np.ndarray, at: np.ndarray, kept: np.ndarray = WORDS) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """All words of texts that stand one after another in ``data``, each from at[i] to at[i + 1]; and the number of words
    before each text."""
    low = kept[data]
    held = low != 0
    begins = held.copy()
    begins[1:] &= ~held[:-1]
    inner = at[:-1][at[:-1] < len(data)]
    begins[inner] = held[inner]
    starts = np.flatnonzero(begins)
    offsets = np.append(np.cumsum(held)[starts] - 1, np.count_nonzero(held)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low[held])])
    return words, np.searchsorted(starts, at)


def split_words(texts: pa.Array, kept: np.ndarray = WORDS) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """All words of a column of texts, and the number of words before each text; a null text has none."""
    return split_bytes(*utf8(texts), kept)


def coded(words: pa.LargeBinaryArray) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    """The number of each word in the array of different words."""
    found = words.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary


def byte_blocks(data: np.ndarray, size: int, kept: np.ndarray = WORDS) -> Iterator[np.ndarray]:
    """A long text cut between words into blocks of about ``size`` bytes; a longer word stays whole."""
    start = 0
    while start < len(data):
        stop = start + size
        while stop < len(data) and kept[data[stop]]:
            rest = kept[data[stop : stop + 4096]] == 0
            stop += int(rest.argmax()) if rest.any() else len(rest)
        yield data[start:stop]
        start = stop


def words(text: Column) -> Column:
    """The same words as an array, by Spark's own functions; a null text has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lower, GAP), "")
