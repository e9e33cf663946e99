"""Long inputs, clashing names and files of other writers."""

import math
import random
import re
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import avi, ctw, license_join, line_dedup, mixing, order_minhash, suffix_dedup

from .test_llm import bit_bytes, jpeg, signed_bits, words_apart


def test_distance_equals_its_definition():
    r = random.Random(1)
    for _ in range(400):
        a = [r.choice("abc") for _ in range(r.randrange(30))]
        b = [r.choice("abc") for _ in range(r.randrange(30))] if r.random() < 0.5 else [x for x in a if r.random() > 0.1]
        want = words_apart(a, b)
        for most in (0, 3, 10, 40):
            assert order_minhash.distance(a, b, most) == (want if want <= most else None)


@pytest.mark.parametrize("change", ["first", "last", "spread", "cut"])
def test_pairs_of_long_texts_take_seconds(change):
    a = [str(i % 5003) for i in range(200_000)]
    b = {"first": ["x", *a[1:]], "last": [*a[:-1], "x"], "spread": [w if i % 10_007 else "x" for i, w in enumerate(a)], "cut": a[700:]}[change]
    began = time.process_time()
    assert order_minhash.similar(a, b)
    assert time.process_time() - began < 8


def test_mix_and_line_dedup_of_clashing_names(spark):
    text = "\n".join(f"line {i} of a passage that stands twice" for i in range(5))
    rows = [(1, "s", text, 7, "a", "b", "c"), (2, "s", text, 8, "a", "b", "c"), (3, None, None, 9, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, digits int, __row string, __marks string, __gone string").withColumns({c: F.lit("mine") for c in ("__fine", "__own0", "end_fine", "a.b")})
    own = {(r["doc_id"], r["digits"], r["__row"], r["__own0"], r["a.b"]) for r in docs.collect()}
    for out in (mixing.mix(docs), line_dedup.dedup_lines(docs)):
        assert {(r["doc_id"], r["digits"], r["__row"], r["__own0"], r["a.b"]) for r in out.collect()} == own
        assert out.columns[: len(docs.columns)] == docs.columns
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()} == {1: text, 2: "", 3: None}


def test_repeats_of_a_bucket_equal_brute_force():
    rng = np.random.default_rng(5)
    length, reach = 30, 30 - suffix_dedup.SAMPLE
    for _ in range(40):
        n = int(rng.integers(1, 40))
        context = rng.integers(97, 99, (n, reach + length)).astype(np.uint8) if rng.random() < 0.5 else np.repeat(rng.integers(97, 99, (3, reach + length)).astype(np.uint8), n, axis=0)[:n]
        context[:, reach : reach + suffix_dedup.SAMPLE] = 120
        bucket, inside = rng.integers(0, 3, n).astype(np.uint64), rng.random((n, reach + 1)) < 0.8
        seen, want = set(), np.zeros((n, reach + 1), bool)
        for i in range(n):
            for o in range(reach + 1):
                key = (o, int(bucket[i]), context[i, reach - o : reach - o + length].tobytes())
                if inside[i, o]:
                    want[i, o] = key in seen
                    seen.add(key)
        assert (suffix_dedup.repeats(bucket, context, inside, length) == want).all()


def usual_code(kind, symbol):
    counts, symbols = avi.USUAL[kind][0], bytes.fromhex(avi.USUAL[kind][1])
    value, at = 0, 0
    for n, k in enumerate(counts, 1):
        for s in symbols[at : at + k]:
            if s == symbol:
                return format(value, f"0{n}b")
            value += 1
        value, at = value << 1, at + k
    raise KeyError(symbol)


def flat_frame(levels, across):
    """A baseline frame without tables of its own: blocks of one level each."""
    bits, before = "", 0
    for v in levels:
        n, extra = signed_bits(v - before)
        bits, before = bits + usual_code(0, n) + extra + usual_code(16, 0), v
    quantities = b"\xff\xdb\0\x43\0" + bytes([8] * 64)
    return jpeg(0xC0, 8 * (len(levels) // across), 8 * across, bit_bytes(bits), [], quantities)


def test_usual_tables():
    for counts, symbols in avi.USUAL.values():
        assert sum(counts) == len(bytes.fromhex(symbols)) == len(set(bytes.fromhex(symbols)))
    levels = [0, 5, -7, 100, -100, 3]
    image = avi.decode_jpeg(flat_frame(levels, 3))
    assert image[::8, ::8].ravel().tolist() == [128 + v for v in levels]


def test_a_large_frame_takes_seconds():
    rng = np.random.default_rng(0)
    side = 1100
    d = rng.integers(-100, 100, side * side)
    pairs = [signed_bits(int(v)) for v in d]
    symbols = [n for n, _ in pairs]
    bits = "".join(format(n, "08b") + extra for n, extra in pairs)
    table = bytes([0, 0, 0, 0, 0, 0, 0, 0, 16, *[0] * 8, *range(16)])
    frame = jpeg(0xC3, side, side, bit_bytes(bits), [table], spectral=bytes([1, 0, 0]))
    assert len(frame) > 1 << 20 and max(symbols) < 16
    began = time.process_time()
    assert avi.decode_jpeg(frame).shape == (side, side)
    assert time.process_time() - began < 20


def open_dml(frames):
    """An AVI file with its frames in two segments and an OpenDML index of each."""
    chunk, micros = avi._chunk, struct.pack("<14I", 40_000, *[0] * 13)
    head = lambda supers: chunk(b"LIST", b"hdrl" + chunk(b"avih", micros) + chunk(b"LIST", b"strl" + chunk(b"indx", struct.pack("<HBBI4sQI", 4, 0, 0, len(supers), b"00dc", 0, 0) + b"".join(struct.pack("<QII", *s) for s in supers))))
    half = len(frames) // 2
    parts, supers, out = [frames[:half], frames[half:]], [(0, 0, 0), (0, 0, 0)], b""
    for _ in range(2):  # sizes first, then places
        out = b""
        found = []
        for kind, some in zip((b"AVI ", b"AVIX"), parts):
            lead = head(supers) if kind == b"AVI " else b""
            base = len(out) + 12 + len(lead)
            body, entries = b"movi", []
            for f in some:
                entries.append((base + 8 + len(body) + 8, len(f)))
                body += chunk(b"00dc", f)
            index = chunk(b"ix00", struct.pack("<HBBI4sQI", 2, 0, 1, len(entries), b"00dc", base, 0) + b"".join(struct.pack("<II", a - base, n | 1 << 31) for a, n in entries))
            found.append((base + 8 + len(body), len(index), len(some)))
            out += chunk(b"RIFF", kind + lead + chunk(b"LIST", body + index))
        supers = found
    return out


def test_open_dml_index():
    frames = [flat_frame([v, -v], 2) for v in (1, 20, 60, 3, 90)]
    media = open_dml(frames)
    micros, found = avi.read_index(media)
    assert micros == 40_000 and [media[a : a + n] for a, n in found] == frames
    assert avi.read_avi(media)[1][:, 0, 0].tolist() == [129, 148, 188, 131, 218]
    without = media.replace(b"indx", b"JUNK").replace(b"ix00", b"JUNK")  # through the movi lists
    assert [without[a : a + n] for a, n in avi.read_index(without)[1]] == frames


def test_context_tree_of_long_texts_in_parts(spark, monkeypatch):
    """Texts above a block are cut between words, and give what whole ones do."""
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["The", "été", "of", "words", "x" * 40]) for _ in range(r.choice([0, 3, 200, 900])))) for i in range(30)] + [(99, "y" * 5000), (100, None), (101, " " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)

    def scores():
        return {x.doc_id: x for x in ctw.score(docs).collect()}

    whole = scores()
    monkeypatch.setattr(ctw, "BLOCK_BYTES", 700)
    parts = scores()
    assert len(parts) == len(whole) == len(rows)
    for k, x in whole.items():
        y = parts[k]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (y.held_out, y.n_tokens, y.n_known, y.train_tokens)
        assert abs(x.base_score - y.base_score) < 1e-6 * max(1, abs(x.base_score)) and abs(x.score - y.score) < 1e-4 * max(1, abs(x.score))


@pytest.mark.parametrize("groups", [1, 7, 5000, 100_000])
def test_context_tree_of_any_number_of_groups(spark, monkeypatch, groups):
    r = random.Random(4)
    docs = spark.createDataFrame([(i, "".join(r.choice("ab \né") for _ in range(r.randrange(60)))) for i in range(80)], "doc_id long, text string").repartition(3)
    want = {x.doc_id: x.score for x in ctw.score(docs).collect()}
    monkeypatch.setattr(ctw, "groups_for", lambda texts: groups)
    got = {x.doc_id: x.score for x in ctw.score(docs).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)


@pytest.mark.parametrize("round_bytes", [1 << 20, 60])
def test_notices_of_a_table(spark, round_bytes):
    """Templates of one's own, in one round and in several."""
    r = random.Random(6)
    some = lambda n: " ".join(f"w{r.randrange(40)}" for _ in range(n))
    notices = [(f"n{i % 9}", some(r.randrange(3, 12))) for i in range(12)] + [("n1", "Ünïcode, WORDS; of a notice"), (None, "no label"), ("empty", " ."), ("none", None)]
    notices += notices[:2]
    texts = [(i, some(r.randrange(60))) for i in range(60)] + [(100 + i, some(20) + " " + (t or "") + " " + some(20)) for i, (_, t) in enumerate(notices)] + [(200, "mit license"), (201, None), (202, "")]
    got = license_join.scan(spark.createDataFrame(texts, "doc_id long, text string"), notices=spark.createDataFrame(notices, "label string, text string"), round_bytes=round_bytes).collect()
    assert len(got) == len(texts)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    texts = dict(texts)
    for x in got:
        w, labels, score = words(texts[x.doc_id]), set(), 0.0
        base = {v for k, v in license_join.PHRASES.items() if f" {k} " in f" {' '.join(w)} "}
        for label, notice in notices:
            n = words(notice)
            if label is None or not n:
                continue
            own, width = set(n), math.ceil(len(n) / 0.8 - 1e-9)
            share = max(len(own & set(w[i : i + width])) for i in range(max(1, len(w) - width + 1)))
            if share >= math.ceil(0.8 * len(own) - 1e-9):
                labels.add(label)
                score = max(score, share / len(own))
        assert x.labels == ",".join(sorted(base | labels)) and math.isclose(x.score, 1.0 if base else score)
