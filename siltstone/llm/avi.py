"""Media columns: motion-JPEG in AVI, read back through the RIFF index, with timed clips between shots.

A payload of bytes becomes gray frames of 24 x 24 samples. Each frame is a lossless JPEG (process SOF3, predictor 1)
whose Huffman table gives category s a code of 9 - s bits. With its s extra bits every difference takes nine bits, so
that a whole batch of frames is coded and decoded by array operations.

Files of others are read too: frames of baseline (SOF0, SOF1) and lossless (SOF3) JPEG with 8-bit samples, by the tables
that they bear or, as usual motion-JPEG leaves them out, by the usual ones; and frames by the idx1 index, by that of
OpenDML, or through the movi lists. What can't be read gives a reason, never a failed job.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, utf8

SIDE = 24
FRAME = SIDE * SIDE
CODED = FRAME * 9 // 8
FPS = 25
#: Samples of another file's frame, at most; a larger one can't be read.
MOST = 1 << 26
HEADER = (
    b"\xff\xd8"
    + b"\xff\xc4" + struct.pack(">HB", 2 + 17 + 9, 0) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))
    + b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, SIDE, SIDE, 1, 1, 0x11, 0)
    + b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)
)
END = b"\xff\xd9"


def _code_words() -> np.ndarray:
    """The nine bits of each difference from -255 to 255."""
    out = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        out[d + 255] = ((1 << (9 - s)) - 2) << s | (d if d > 0 else d - 1 + (1 << s) if d else 0)
    return out


WORDS = _code_words()
DIFFS = np.zeros(512, np.int16)
DIFFS[WORDS] = np.arange(-255, 256)


def encode_frames(samples: np.ndarray) -> np.ndarray:
    """(n, 24, 24) samples -> (n, 648) entropy-coded bytes before byte stuffing."""
    x = samples.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    w = WORDS[d + 255].reshape(-1, 8)
    out = np.empty((len(w), 9), np.uint8)
    out[:, 0] = w[:, 0] >> 1
    for i in range(1, 8):
        out[:, i] = (w[:, i - 1] & ((1 << i) - 1)) << (8 - i) | w[:, i] >> (i + 1)
    out[:, 8] = w[:, 7] & 255
    return out.reshape(-1, CODED)


def decode_frames(coded: np.ndarray) -> np.ndarray:
    """(n, 648) entropy-coded bytes without stuffing -> (n, 24, 24) samples."""
    b = coded.reshape(-1, 9).astype(np.uint16)
    w = np.empty((len(b), 8), np.uint16)
    for i in range(8):
        w[:, i] = (b[:, i] & ((1 << (8 - i)) - 1)) << (i + 1) | b[:, i + 1] >> (7 - i)
    d = DIFFS[w].reshape(-1, SIDE, SIDE)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1, dtype=np.int16)
    return (np.cumsum(d, axis=2, dtype=np.int16) & 255).astype(np.uint8)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(coded: np.ndarray, fps: int = FPS) -> bytes:
    """An AVI file of the given frames: header lists, the frames' chunks, and an idx1 index of them."""
    raw, frames, index, at = coded.tobytes(), [], [], 4
    for i in range(len(coded)):
        body = HEADER + raw[i * CODED : (i + 1) * CODED].replace(b"\xff", b"\xff\0") + END
        frames.append(_chunk(b"00dc", body))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(body)))
        at += len(frames[-1])
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    return _chunk(b"RIFF", b"AVI " + hdrl + _chunk(b"LIST", b"movi" + b"".join(frames)) + _chunk(b"idx1", b"".join(index)))


class Unreadable(ValueError):
    """Why a file or a frame can't be read."""


def read_index(media: bytes) -> tuple[int, list[tuple[int, int]]]:
    """(microseconds a frame, [(offset, length) of each video frame]) by the RIFF lists and the OpenDML or idx1 index; a file without
    an index is read through its movi lists, of which files above a gigabyte have several."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise Unreadable("not an AVI file")
    at, movies, micros, index, supers = 12, [], 0, b"", []
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"RIFF":  # a further segment
            at += 12
            continue
        if kind == b"LIST" and media[at + 8 : at + 12] == b"hdrl" and at + 24 <= len(media):
            micros = struct.unpack_from("<I", media, at + 20)[0]
            supers = [(a, n) for a, n in _walk(media, at + 12, min(len(media), at + 8 + size), (b"indx",))]
        elif kind == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movies.append((at + 8, min(len(media), at + 8 + size)))
        elif kind == b"idx1" and not index:
            index = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if not movies:
        raise Unreadable("no movi list")
    if found := [f for a, n in supers for f in _open_index(media, a, n)]:
        return micros, found
    entries = np.frombuffer(index[: len(index) // 16 * 16], np.dtype([("kind", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]))
    frames = [(int(e["at"]), int(e["size"])) for e in entries if e["kind"][2:] in (b"dc", b"db")]
    if not frames or len(movies) > 1:
        return micros, [f for a, b in movies for f in _walk(media, a + 4, b)]
    first = movies[0][0]
    base = first if media[first + frames[0][0] + 2 : first + frames[0][0] + 4] in (b"dc", b"db") else 0  # some count from the file's start
    return micros, [(base + at + 8, size) for at, size in frames]


def _open_index(media: bytes, at: int, size: int, deep: bool = True) -> list[tuple[int, int]]:
    """Frames of an OpenDML index at this place: of frames itself, or of further indexes."""
    if size < 24 or at + 24 > len(media):
        return []
    words, _, kind, n, chunk, base = struct.unpack_from("<HBBI4sQ", media, at)
    if chunk[2:] not in (b"dc", b"db"):
        return []
    if kind == 1 and words == 2:
        n = min(n, (len(media) - at - 24) // 8)
        entries = np.frombuffer(media, "<u4", 2 * n, at + 24).astype(np.int64).reshape(-1, 2)
        return [(base + a, s & 0x7FFFFFFF) for a, s in entries.tolist() if base + a < len(media)]
    if kind == 0 and words == 4 and deep:
        n = min(n, (len(media) - at - 24) // 16)
        parts = [struct.unpack_from("<QII", media, at + 24 + 16 * i) for i in range(n)]
        return [f for a, s, _ in parts for f in _open_index(media, a + 8, s - 8, False)]
    return []


def _walk(media: bytes, at: int, end: int, wanted: tuple[bytes, ...] = (b"dc", b"db")) -> Iterator[tuple[int, int]]:
    """(offset, length) of the chunks whose names end so, in lists within lists."""
    while at + 8 <= end:
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"LIST":
            at += 12
            continue
        if kind.endswith(wanted):
            yield at + 8, size
        at += 8 + size + (size & 1)


# The order in which a block's coefficients are stored, by row * 8 + column.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
COSINES = np.array([[math.sqrt((1 if u == 0 else 2) / 8) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)])


# The Huffman tables that frames use which leave theirs out, by kind and number: how many codes each length has, and the symbols.
USUAL = {
    0x00: ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], "00 01 02 03 04 05 06 07 08 09 0a 0b"),
    0x01: ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], "00 01 02 03 04 05 06 07 08 09 0a 0b"),
    0x10: (
        [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125],
        "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82 09 0a 16 17 18 19 1a 25 26 27 28 29 2a "
        "34 35 36 37 38 39 3a 43 44 45 46 47 48 49 4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a 73 74 75 76 77 78 79 7a 83 84 85 86 87 88 89 8a "
        "92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 ba c2 c3 c4 c5 c6 c7 c8 c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da "
        "e1 e2 e3 e4 e5 e6 e7 e8 e9 ea f1 f2 f3 f4 f5 f6 f7 f8 f9 fa",
    ),
    0x11: (
        [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119],
        "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1 17 18 19 1a 26 27 28 29 2a "
        "35 36 37 38 39 3a 43 44 45 46 47 48 49 4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a 73 74 75 76 77 78 79 7a 82 83 84 85 86 87 88 89 8a "
        "92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 ba c2 c3 c4 c5 c6 c7 c8 c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da "
        "e2 e3 e4 e5 e6 e7 e8 e9 ea f2 f3 f4 f5 f6 f7 f8 f9 fa",
    ),
}


@lru_cache(maxsize=64)
def prefixes(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits length << 8 | symbol of the code that they begin with; 0 where there is none."""
    out, value, at = [0] * (1 << 16), 0, 0
    for n, k in enumerate(counts, 1):
        for symbol in symbols[at : at + k]:
            if value >> n:
                raise Unreadable("a table of more codes than there are")
            out[value << 16 - n : value + 1 << 16 - n] = [n << 8 | symbol] * (1 << 16 - n)
            value += 1
        value, at = value << 1, at + k
    return out


class _Bits:
    """Bits of entropy-coded bytes, read through a window of some 64 of them."""

    def __init__(self, raw: bytes):
        self.raw, self.next, self.window, self.n = raw, 0, 0, 0
        self.left = 8 * len(raw)

    def _fill(self) -> None:
        some = self.raw[self.next : self.next + 6]
        self.next += 6
        self.window = (self.window & (1 << self.n) - 1) << 48 | int.from_bytes(some.ljust(6, b"\0"), "big")
        self.n += 48

    def _drop(self, n: int) -> None:
        self.left -= n
        self.n -= n
        if self.left < 0:
            raise Unreadable("a frame's data end early")

    def take(self, n: int) -> int:
        if self.n < n:
            self._fill()
        value = self.window >> self.n - n & (1 << n) - 1
        self._drop(n)
        return value

    def symbol(self, table: list[int]) -> int:
        if self.n < 16:
            self._fill()
        found = table[self.window >> self.n - 16 & 0xFFFF]
        if not found:
            raise Unreadable("a code outside the frame's table")
        self._drop(found >> 8)
        return found & 255

    def signed(self, n: int) -> int:
        value = self.take(n) if n else 0
        return value if not n or value >> (n - 1) else value - (1 << n) + 1


def decode_jpeg(body: bytes) -> np.ndarray:
    """Samples (rows, columns) of the first component of a baseline or lossless JPEG image."""
    if body[:2] != b"\xff\xd8":
        raise Unreadable("not a JPEG frame")
    at, quantities, frame, restart = 2, {}, None, 0
    tables = {k: prefixes(bytes(counts), bytes.fromhex(symbols)) for k, (counts, symbols) in USUAL.items()}
    while at + 4 <= len(body):
        if body[at] != 0xFF:
            raise Unreadable("no marker where one is due")
        marker, size = body[at + 1], struct.unpack_from(">H", body, at + 2)[0]
        part, at = body[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while part:
                width = 1 + (part[0] >> 4)
                quantities[part[0] & 15] = np.frombuffer(part[1 : 1 + 64 * width], ">u2" if width == 2 else np.uint8).astype(np.int64)
                part = part[1 + 64 * width :]
        elif marker == 0xC4:
            while part:
                end = 17 + sum(part[1:17])
                tables[part[0]] = prefixes(bytes(part[1:17]), bytes(part[17:end]))
                part = part[end:]
        elif marker in (0xC0, 0xC1, 0xC3):
            bits, rows, columns, n = struct.unpack_from(">BHHB", part)
            if bits != 8 or not rows or not columns:
                raise Unreadable("samples of other than 8 bits, or no size")
            if rows * columns > MOST:
                raise Unreadable("a frame of more samples than a task may hold")
            frame = marker, rows, columns, [(part[6 + 3 * i], part[7 + 3 * i] >> 4, part[7 + 3 * i] & 15, part[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise Unreadable("a JPEG process other than baseline and lossless")
        elif marker == 0xDD:
            restart = struct.unpack_from(">H", part)[0]
        elif marker == 0xDA:
            if frame is None:
                raise Unreadable("a scan before its frame")
            picked = {part[1 + 2 * i]: part[2 + 2 * i] for i in range(part[0])}
            if len(picked) != len(frame[3]):
                raise Unreadable("components in scans of their own")
            end = body.rfind(b"\xff\xd9")
            runs = re.split(rb"\xff[\xd0-\xd7]", body[at : end if end >= at else len(body)]) if restart else [body[at : end if end >= at else len(body)]]
            scans = [_Bits(r.replace(b"\xff\0", b"\xff")) for r in runs]
            try:
                return _lossless(frame, picked, tables, scans, restart, part[-3]) if frame[0] == 0xC3 else _baseline(frame, picked, tables, quantities, scans, restart)
            except (KeyError, IndexError) as e:
                raise Unreadable("a table that the frame doesn't bear") from e
    raise Unreadable("no scan")


def _baseline(frame: tuple, picked: dict, tables: dict, quantities: dict, scans: list[_Bits], restart: int) -> np.ndarray:
    _, rows, columns, parts = frame
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:
        parts, most_h, most_v = [(parts[0][0], 1, 1, parts[0][3])], 1, 1
    wide, high = -(-columns // (8 * most_h)), -(-rows // (8 * most_v))
    _, h, v, q = parts[0]
    out, before = np.zeros((high * v * 8, wide * h * 8)), {}
    for unit in range(wide * high):
        if not unit or restart and unit % restart == 0:
            bits, before = scans[unit // restart if restart else 0], {p[0]: 0 for p in parts}
        for i, (name, across, down, _) in enumerate(parts):
            dc, ac = tables[picked[name] >> 4], tables[16 | picked[name] & 15]
            for y in range(down):
                for x in range(across):
                    block = np.zeros(64)
                    before[name] += bits.signed(bits.symbol(dc))
                    block[0], k = before[name], 1
                    while k < 64:
                        run, size = divmod(bits.symbol(ac), 16)
                        if not size and run < 15:
                            break
                        k += run
                        block[ZIGZAG[k]], k = (bits.signed(size) * quantities[q][k] if not i else bits.signed(size)), k + 1
                    if not i:
                        block[0] *= quantities[q][0]
                        top, left = (unit // wide * v + y) * 8, (unit % wide * h + x) * 8
                        out[top : top + 8, left : left + 8] = COSINES.T @ block.reshape(8, 8) @ COSINES
    return np.clip(np.rint(out + 128), 0, 255).astype(np.uint8)[: -(-rows * v // most_v), : -(-columns * h // most_h)]


def _lossless(frame: tuple, picked: dict, tables: dict, scans: list[_Bits], restart: int, predictor: int) -> np.ndarray:
    _, rows, columns, parts = frame
    if any((p[1], p[2]) != (1, 1) for p in parts) and len(parts) > 1:
        raise Unreadable("lossless components of different sizes")
    if not 1 <= predictor <= 7 or (restart and restart % columns):
        raise Unreadable("a lossless scan of another kind")
    out, per = np.zeros((len(parts), rows, columns), np.int64), restart // columns if restart else rows
    for y in range(rows):
        bits, top = scans[y // per], y % per == 0
        for x in range(columns):
            for i, (name, *_) in enumerate(parts):
                size = bits.symbol(tables[picked[name] >> 4])
                difference = 32768 if size == 16 else bits.signed(size)
                o = out[i]
                if top:
                    guess = 128 if x == 0 else o[y, x - 1]
                elif x == 0:
                    guess = o[y - 1, 0]
                else:
                    a, b, c = o[y, x - 1], o[y - 1, x], o[y - 1, x - 1]
                    guess = (0, a, b, c, a + b - c, a + (b - c >> 1), b + (a - c >> 1), a + b >> 1)[predictor]
                o[y, x] = guess + difference & 65535
    return (out[0] & 255).astype(np.uint8)


def read_avi(media: bytes) -> tuple[int, np.ndarray]:
    """(microseconds a frame, (n, rows, columns) samples) of an AVI file of JPEG frames, which must have one size."""
    micros, index = read_index(media)
    bodies = [media[at : at + size] for at, size in index]
    if all(b.startswith(HEADER) and b.endswith(END) for b in bodies):  # this module's own
        coded = b"".join(b[len(HEADER) : -2].replace(b"\xff\0", b"\xff") for b in bodies)
        if len(coded) != CODED * len(bodies):
            raise Unreadable("a frame's data end early")
        return micros, decode_frames(np.frombuffer(coded, np.uint8).reshape(-1, CODED))
    frames = [decode_jpeg(b) for b in bodies]
    if len({f.shape for f in frames}) > 1:
        raise Unreadable("frames of different sizes")
    return micros, np.stack(frames)


def cuts(frames: np.ndarray, bins: int = 16, window: int = 12, factor: float = 2.0, least: float = 0.05) -> np.ndarray:
    """Frames that begin a shot: the histogram's change is above ``least`` and above mean + factor * deviation of the
    changes of up to ``window`` frames before."""
    n = len(frames)
    if n < 2:
        return np.zeros(min(n, 1), np.int64)
    pixels = frames.reshape(n, -1)
    binned = pixels // (256 // bins) + (np.arange(n, dtype=np.int64) * bins)[:, None]
    hist = np.bincount(binned.ravel(), minlength=n * bins).reshape(n, bins)
    change = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2.0 * pixels.shape[1])
    s1, s2 = np.concatenate([[0], np.cumsum(change)]), np.concatenate([[0], np.cumsum(change * change)])
    i = np.arange(n - 1)
    a = np.maximum(0, i - window)
    k = np.maximum(1, i - a)
    mean = (s1[i] - s1[a]) / k
    deviation = np.sqrt(np.maximum(0, (s2[i] - s2[a]) / k - mean * mean))
    return np.concatenate([[0], 1 + np.flatnonzero((change > least) & (change > mean + factor * deviation + 1e-9) & (i > 0))])


def encode_avi(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, media: every text (null: empty) as UTF-8, filled up with bytes 255 to a positive multiple of 576,
    as an AVI file. A null key stays null, repeated rows stay repeated, other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", 1 << 20):
            data, at = utf8(batch.column("__text"))
            size = np.diff(at)
            frames = np.maximum(1, -(-size // FRAME))
            first = np.concatenate([[0], np.cumsum(frames)])
            payload = np.full(first[-1] * FRAME, 255, np.uint8)
            for i in range(len(size)):
                payload[first[i] * FRAME : first[i] * FRAME + size[i]] = data[at[i] : at[i + 1]]
            coded = encode_frames(payload.reshape(-1, SIDE, SIDE))
            media = [write_avi(coded[first[i] : first[i + 1]]) for i in range(len(size))]
            yield pa.RecordBatch.from_arrays([batch.column("__key"), pa.array(size, pa.int64()), pa.array(media, pa.binary())], ["__key", "n_bytes", "media"])

    picked = docs.select(docs[key].alias("__key"), docs[text].alias("__text"))
    kind = picked.schema["__key"].dataType.simpleString()
    return picked.mapInArrow(run, f"__key {kind}, n_bytes long, media binary").withColumnRenamed("__key", key)


CLIP = pa.struct([("clip", pa.int64()), ("start_frame", pa.int64()), ("end_frame", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64())])


def read_media(media: DataFrame, column: str = "media") -> DataFrame:
    """Every row of ``media`` with what is read back from the AVI in ``column``, instead of it: payload_bytes,
    payload_sha256, tail_crc32 (of the last 32 bytes) of all samples, media_bytes, media_sha256, frames, luma (mean), clips
    (clip, start_frame, end_frame, start_s, end_s of each shot) and error.

    A null AVI has null in all of them. One that can't be read has its bytes and hash, the reason in error, and null in
    the others. Columns with a new column's name are left out.
    """
    new = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "frames", "luma", "clips", "error"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.list_(CLIP), pa.string()]
    own = [c for c in media.columns if c not in new and c != column]

    def one(m: bytes | None) -> tuple:
        if m is None:
            return (None,) * 9
        file = len(m), hashlib.sha256(m).hexdigest()
        try:
            micros, frames = read_avi(m)
        except Unreadable as e:
            return (None, None, None, *file, None, None, None, str(e))
        except (struct.error, ValueError, LookupError, ArithmeticError) as e:
            return (None, None, None, *file, None, None, None, f"damaged: {e}")
        payload, first = frames.tobytes(), cuts(frames).tolist()
        clips = [{"clip": k, "start_frame": a, "end_frame": b, "start_s": a * micros / 1e6, "end_s": b * micros / 1e6} for k, (a, b) in enumerate(zip(first, [*first[1:], len(frames)]))]
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *file, len(frames), float(frames.mean()) if len(frames) else None, clips, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__media", 1 << 20):
            rows = [one(m) for m in batch.column("__media").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], [*names, *new])

    picked = media.select(*own, F.col(column).cast("binary").alias("__media"))
    names = picked.columns[:-1]
    clip = "array<struct<clip:long,start_frame:long,end_frame:long,start_s:double,end_s:double>>"
    told = T.StructType.fromDDL(f"payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames long, luma double, clips {clip}, error string")
    return picked.mapInArrow(run, T.StructType([*picked.schema.fields[:-1], *told.fields]))


def avi_clips(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """A row for each shot of each AVI in ``column``: key, clip, start_frame, end_frame, start_s, end_s, error. A null AVI
    has none; one that can't be read has one row with null in all but key and error."""
    read = read_media(media.select(F.col(key), F.col(column).alias("__avi")), "__avi").where("media_bytes is not null")
    return read.select(F.col(key), F.explode_outer("clips").alias("c"), "error").where("c is not null or error is not null").select(key, "c.*", "error")


def feature() -> Column:
    """Frames, shots, their times and the mean sample of what ``read_media`` gives, as text."""
    times = F.transform("clips", lambda c: F.format_string("%.2f-%.2f", c["start_s"], c["end_s"]))
    return F.concat(F.lit("frames="), "frames", F.lit(";shots="), F.size("clips"), F.lit(";clips="), F.array_join(times, ","), F.lit(";luma="), F.format_string("%.3f", F.col("luma")))
