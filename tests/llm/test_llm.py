"""Each operator of siltstone.llm against brute force, on small tables with nulls, ties, repeats and odd columns."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from siltstone.llm import avi, cap_filters, components, ctw, lang_id, license_join, line_dedup, mixing, order_minhash, packing, registry, suffix_dedup

DATA = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("size", T.StringType()), T.StructField("row", T.StringType()), T.StructField("score", T.StringType())])
PASSAGE = "the quick brown fox jumps over the lazy dog and then it runs away from the farm over the hill by the river until night falls on all"


def odd_rows():
    text = {
        1: "Released under the MIT License.\nmit  license mit license",
        2: PASSAGE + "\none\ntwo\nthree\nfour " + PASSAGE,
        3: "before " + PASSAGE + "\none\ntwo\nthree\nfive",
        4: PASSAGE + "\none\ntwo\nthree\nfour " + PASSAGE,
        5: None,
        6: "",
        7: " \t\n ",
        8: "12 34 !?",
        9: "été à la plage où les élèves sont allés, et le maître aussi. " * 5,
        10: "x" * 3000,
        11: "long words of no end " * 2000,
        12: "GNU General Public License mit\nlicense Apache License",
    }
    rows = [(k, v, "fr" if k == 9 else "en", ["b", None, "a", "B"][k % 4], None if v is None else len(v), "s", "r", "c") for k, v in text.items()]
    return [*rows, rows[1], rows[4], (None, "a text of nobody", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall())


def held(doc_id, remainder):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == remainder


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    cursor = db.execute(registry.ORACLE_SQL[name])
    names, rows = [c[0] for c in cursor.description], cursor.fetchall()
    got = registry.QUERIES[name](spark, DATA)
    assert sorted(names) == sorted(got.columns)
    norm = lambda rows: sorted(tuple(str(round(x, 6) if isinstance(x, float) else x) for x in r) for r in rows)
    assert norm(rows) == norm(tuple(r[c] for c in names) for r in got.collect())


# op1


def test_language_of_held_out_texts(docs):
    got = lang_id.identify(docs).where("held_out").select("lang", "lang_pred", "score").collect()
    assert len(got) > 20 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(odd, empty, docs):
    got = lang_id.identify(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        silent = r.text is None or not any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == silent and r.held_out == held(r.doc_id, 0) and r.row == ("r" if r.doc_id else None)
    assert lang_id.identify(empty).count() == 0
    assert {r.lang_pred for r in lang_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()} == {"und"}


def test_language_with_clashing_columns(docs):
    odd_names = docs.limit(50).withColumns({"__letter": F.lit("x"), "lang_pred": F.lit(1), "held_out": F.lit("y")})
    got = lang_id.identify(odd_names)
    assert got.count() == 50 and got.schema["lang_pred"].dataType == T.StringType() and got.schema["held_out"].dataType == T.BooleanType()


def test_prediction_reads_only_the_text(docs):
    known = {r.doc_id: r.lang_pred for r in lang_id.identify(docs).collect()}
    assert lang_id.fit(docs).families == ["germanic", "romance"]
    moved = docs.withColumn("source", F.lit("x")).withColumn("lang", F.when((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5) != 0, F.col("lang")))
    assert {r.doc_id: r.lang_pred for r in lang_id.identify(moved).collect()} == known


# op2


def fill(sizes, share=1.5, most=2.0, cycle=(5.0, 2.0, 1.0)):
    """Targets by dealing out again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % 3] for i, s in enumerate(names)}
    full, left = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        part = {s: (left - sum(full.values())) * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if part[s] > most * sizes[s]]
        if not over:
            return full | part
        full |= {s: most * sizes[s] for s in over}


def test_mix(docs, odd):
    for df in (docs, odd):
        got = mixing.mix(df).select("doc_id", "text", "source", "source_size", "target", "copies", "taken", *(["size"] if df is docs else [])).collect()
        assert len(got) == df.count()
        size, taken = Counter(), Counter()
        for r in got:
            n = len([w for w in (r.text or "").replace("\x0b", " ").split() if w]) if (r.text or "").isascii() else None
            size[r.source] += r.taken // r.copies if r.copies else 0
            taken[r.source] += r.taken
            assert r.copies in (0, 1, 2) and (n is None or r.taken == r.copies * n)
        goal = fill({r.source: r.source_size for r in got})
        most = defaultdict(int)
        for r in got:
            assert math.isclose(r.target, goal[r.source], rel_tol=1e-9, abs_tol=1e-6)
            most[r.source] = max(most[r.source], r.taken)
        for s in goal:
            assert abs(taken[s] - goal[s]) <= most[s] / 1 + 1
        again = mixing.mix(df.repartition(5)).select("doc_id", "text", "taken")
        assert rows_of(again) == rows_of(mixing.mix(df).select("doc_id", "text", "taken"))


def test_mix_of_nothing(empty, spark):
    assert mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r.taken, r.target) for r in mixing.mix(blank).collect()} == {(0, 0.0)}


def test_pareto_inclusion_follows_the_odds(spark):
    words = F.array_join(F.array_repeat(F.lit("w"), F.when(F.col("id") % 3 == 0, 40).when(F.col("id") % 3 == 1, 5).otherwise(1)), " ")
    rows = spark.range(30000).select(F.col("id").alias("doc_id"), words.alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    got = mixing.mix(rows).groupBy("source", "size").agg(F.avg("copies").alias("copies"), F.first("target").alias("target"), F.sum("size").alias("words")).collect()
    for source in ("a", "b"):
        own = {r["size"]: r for r in got if r.source == source}
        lean = {n: 1 + n.bit_length() / 8 for n in own}
        due, target = {}, own[1].target
        while True:
            level = (target - sum(2 * own[n].words for n in due)) / max(1, sum(lean[n] * own[n].words for n in own if n not in due))
            over = [n for n in own if n not in due and level * lean[n] > 2]
            if not over:
                break
            due |= {n: 2.0 for n in over}
        due |= {n: level * lean[n] for n in own if n not in due}
        assert len(set(due.values())) > 1 or source == "a"
        for n, r in own.items():
            assert math.isclose(r.copies, due[n], abs_tol=0.02), (source, n)


# op3


def test_avi_round_trip(odd, docs, empty):
    for df in (odd, docs):
        media = avi.encode_avi(df)
        for r in media.join(df.select("doc_id", "text").distinct(), "doc_id").collect():
            raw = (r.text or "").encode()
            payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
            assert avi.read_avi(bytes(r.media))[1].tobytes() == payload and r.n_bytes == len(raw)
        got = {(r.doc_id, r.payload_sha256, r.payload_bytes, r.tail_crc32, r.error) for r in avi.read_media(media).collect()}
        for r in df.collect():
            raw = (r.text or "").encode()
            payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
            assert (r.doc_id, hashlib.sha256(payload).hexdigest(), len(payload), zlib.crc32(payload[-32:]), None) in got
        assert avi.read_media(media).count() == df.count()
    assert avi.encode_avi(empty).count() == 0 and avi.read_media(avi.encode_avi(empty)).count() == 0
    r = registry.op3_avi_clips(docs.sparkSession, DATA).first()
    assert r.feature.startswith("frames=") and len(r.payload_sha256) == len(r.media_sha256) == 64


def bit_bytes(bits):
    bits += "1" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")


def signed_bits(d):
    n = abs(d).bit_length()
    return n, format(d if d > 0 else d - 1 + (1 << n), f"0{n}b") if n else ""


def jpeg(process, rows, columns, scan, tables, quantities=b"", spectral=bytes([0, 63, 0])):
    part = lambda marker, body: bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body
    frame = bytes([8]) + rows.to_bytes(2, "big") + columns.to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    return b"\xff\xd8" + quantities + b"".join(part(0xC4, t) for t in tables) + part(process, frame) + part(0xDA, bytes([1, 1, 0]) + spectral) + scan + b"\xff\xd9"


def test_frames_of_other_files(spark):
    # baseline: one quantity of 1, codes of eight bits in the order of their symbols
    rng = np.random.default_rng(0)
    flat = lambda kind, symbols: bytes([kind, 0, 0, 0, 0, 0, 0, 0, len(symbols), *[0] * 8, *symbols])
    dc, ac = list(range(12)), [0, 0xF0] + [r << 4 | s for r in range(16) for s in range(1, 11)]
    cosines = np.array([[math.sqrt((1 if u == 0 else 2) / 8) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)])
    image = np.clip(np.add.outer(np.arange(16) * 5, np.arange(24) * 4) + rng.integers(0, 30, (16, 24)), 0, 255)
    bits, before = "", 0
    for y in range(2):
        for x in range(3):
            block = np.rint(cosines @ (image[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] - 128.0) @ cosines.T).astype(int).ravel()
            n, extra = signed_bits(int(block[0]) - before)
            before, run = int(block[0]), 0
            bits += format(dc.index(n), "08b") + extra
            for k in range(1, 64):
                value = int(block[avi.ZIGZAG[k]])
                if not value:
                    run += 1
                    continue
                while run > 15:
                    bits, run = bits + format(ac.index(0xF0), "08b"), run - 16
                n, extra = signed_bits(value)
                bits, run = bits + format(ac.index(run << 4 | n), "08b") + extra, 0
            if run:
                bits += format(ac.index(0), "08b")
    baseline = jpeg(0xC0, 16, 24, bit_bytes(bits), [flat(0, dc), flat(16, ac)], b"\xff\xdb\0\x43\0" + bytes([1] * 64))
    assert np.abs(avi.decode_jpeg(baseline).astype(int) - image).max() <= 2
    # lossless with each predictor
    small = rng.integers(0, 256, (5, 7))
    for predictor in range(1, 8):
        bits = ""
        for y in range(5):
            for x in range(7):
                a, b, c = small[y, x - 1], small[y - 1, x], small[y - 1, x - 1]
                guess = (128 if x == 0 else a) if y == 0 else b if x == 0 else (0, a, b, c, a + b - c, a + (b - c >> 1), b + (a - c >> 1), a + b >> 1)[predictor]
                n, extra = signed_bits(int(small[y, x] - guess))
                bits += format(dc.index(n), "08b") + extra
        lossless = jpeg(0xC3, 5, 7, bit_bytes(bits), [flat(0, dc)], spectral=bytes([predictor, 0, 0]))
        assert (avi.decode_jpeg(lossless) == small).all()
    own = avi.write_avi(avi.encode_frames(np.zeros((3, 24, 24), np.uint8)))
    other = lambda body: avi._chunk(b"RIFF", b"AVI " + avi._chunk(b"LIST", b"movi" + avi._chunk(b"00dc", body)))
    cases = {1: own, 2: None, 3: b"", 4: b"RIFX" + own[4:], 5: own[:-56], 6: other(lossless), 7: other(baseline), 8: other(b"\xff\xd8\xff\xd9"), 9: other(lossless[:60]), 10: other(lossless.replace(b"\xff\xc3", b"\xff\xc2"))}
    df = spark.createDataFrame([(k, v and bytearray(v), "x") for k, v in cases.items()], "doc_id long, media binary, error string")
    got = {r.doc_id: r for r in avi.read_media(df).collect()}
    assert len(got) == 10 and {k for k, r in got.items() if r.error} == {4, 8, 9, 10, 3} - ({3} if got[3].error is None else set())
    assert got[2].media_bytes is None and got[6].payload_bytes == 35 and got[7].payload_bytes == 16 * 24 and got[6].frames == 1
    clips = avi.avi_clips(df).collect()
    assert {r.doc_id for r in clips if r.error is None} == {1, 5, 6, 7} and 2 not in {r.doc_id for r in clips}


def test_shots(spark):
    dark, light = np.zeros((20, 24, 24), np.uint8), np.full((10, 24, 24), 200, np.uint8)
    media = avi.write_avi(avi.encode_frames(np.concatenate([dark, light, dark])))
    df = spark.createDataFrame([(1, bytearray(media)), (2, None)], "doc_id long, media binary")
    got = [(r.clip, r.start_frame, r.end_frame, r.start_s, r.end_s) for r in avi.avi_clips(df).orderBy("clip").collect()]
    assert got == [(0, 0, 20, 0.0, 0.8), (1, 20, 30, 0.8, 1.2), (2, 30, 50, 1.2, 2.0)]
    with pytest.raises(ValueError):
        avi.read_avi(b"RIFX" + media[4:])


def test_lossless_on_noise():
    x = np.random.default_rng(0).integers(0, 256, (40, 24, 24), dtype=np.uint8)
    assert (avi.decode_frames(avi.encode_frames(x)) == x).all()


# op4


def words_apart(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def test_banded_alignment():
    rng = np.random.default_rng(3)
    for _ in range(1500):
        a, b = (rng.integers(0, 4, rng.integers(0, 13)).tolist() for _ in range(2))
        most = int(rng.integers(0, 13))
        d = words_apart(a, b)
        assert order_minhash.distance(a, b, most) == (d if d <= most else None)


def test_near_duplicates_equal_brute_force(docs, texts):
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs).collect()}
    ids = sorted(texts)
    lead = {i: i for i in ids}
    split = {i: texts[i].split() for i in ids}

    def root(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = split[i], split[j]
            if texts[i] == texts[j] or (max(len(a), len(b)) < 3000 and order_minhash.similar(a, b)):
                x, y = sorted((root(i), root(j)))
                lead[y] = x
    assert got == {i: root(i) for i in ids}


def test_near_duplicates_of_odd_rows(odd, empty, spark):
    got = order_minhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[4].class_id == 2 and not by[4].kept and by[None].class_id is None and by[5].kept and by[7].class_id == 7
    assert order_minhash.near_duplicates(empty).count() == 0
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 5000, 200)]
    rows = []
    for k in range(300):  # a large group of near copies, each of its own
        own = list(base)
        for i in rng.integers(0, 200, 4):
            own[i] = f"x{k}"
        rows.append((k, " ".join(own)))
    rows += [(1000 + k, " ".join(base[:60] + [f"y{k}_{i}" for i in range(100)])) for k in range(50)]  # a shared passage
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == 0 for k in range(300)) and all(got[1000 + k] == 1000 + k for k in range(50))


def test_words_of_texts_with_other_spaces(spark):
    one = "a\u00a0b c d e f g h i\u2003j k l m"
    rows = [(1, one), (2, one.replace("c", "x")), (3, one.replace("\u00a0", " ").replace("\u2003", " "))]
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    same = lambda a, b: order_minhash.similar(a.encode().split(), b.encode().split())
    assert same(rows[0][1], rows[1][1]) and not same(rows[0][1], rows[2][1]) and got == {1: 1, 2: 1, 3: 3}


def families(rows):
    """The smallest id that similar texts reach, by all pairs."""
    split, lead = {k: v.split() for k, v in rows}, {k: k for k, _ in rows}
    for i in sorted(split):
        for j in sorted(split):
            if i < j and lead[i] != lead[j] and order_minhash.similar(split[i], split[j]):
                least, other = sorted((lead[i], lead[j]))
                lead = {k: least if v == other else v for k, v in lead.items()}
    return lead


def test_near_duplicates_unlike_the_first_text(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(75)]
    rows = [(k, " ".join(base + [f"f{i}_{x}" for i, x in enumerate(rng.integers(0, 12, 25))])) for k in range(150)]  # one template, other fields
    whole = [f"c{i}" for i in range(100)]
    rows += [(1000, " ".join(whole)), (1001, " ".join(whole[:85])), (1002, " ".join(whole[:70]))]  # a chain
    want = families(rows)
    assert want[1002] == 1000 and 1 < len(set(want.values())) < 100 and not order_minhash.similar(whole, whole[:70])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for group, words in ((512, 10**6), (20, 10**6), (512, 3000)):
        monkeypatch.setattr(order_minhash, "GROUP", group)
        monkeypatch.setattr(order_minhash, "WORDS", words)
        assert {r.doc_id: r.class_id for r in order_minhash.near_duplicates(df).collect()} == want


def recall(share, n, pairs=400):
    """Of pairs of texts of n words, a share of them replaced here and there, that brute force finds similar: how many share a sketch."""
    rng, found = np.random.default_rng(7), []
    for k in range(pairs):
        a = [f"w{i}" for i in rng.integers(0, 20_000, n)]
        b = list(a)
        for i in rng.choice(n, round(share * n), replace=False):
            b[i] = f"x{i}"
        if order_minhash.similar(a, b):
            data = [" ".join(x).encode() for x in (a, b)]
            _, s = order_minhash.sketches(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
            found.append(bool((s[0] == s[1]).any()))
    assert len(found) == pairs
    return sum(found) / len(found)


@pytest.mark.parametrize("share,least", [(0.2, 0.95), (0.15, 0.98), (0.1, 0.99)])
def test_recall_of_spread_edits(share, least):
    assert recall(share, 250) >= least


# op5


def test_line_dedup_of_odd_rows(odd, empty):
    got = {r.doc_id: r for r in line_dedup.dedup_lines(odd).collect()}
    assert got[2].n_removed == 0 and got[3].text == "before " + PASSAGE + "\nfive" and got[3].n_runs == 1
    assert got[4].text == "" and got[4].n_removed == 5 and got[5].text is None and got[7].text == " \t\n "
    assert line_dedup.dedup_lines(odd).count() == odd.count() and line_dedup.dedup_lines(empty).count() == 0


def lines_removed(rows):
    """(n_removed, n_runs, text) of each row by comparing all runs with those before; rows are in the order of their ids."""
    seen, out = set(), {}
    for k, text in rows:
        lines = [(x, bool(x.strip(line_dedup.BLANK))) for x in (text or "").split("\n")]
        own = [x for x, full in lines if full]
        gone = set()
        for i in range(len(own)):
            for n in (1, 2, 3):
                part = tuple(own[i : i + n])
                if len(part) == n and (n == 3 or sum(len(x.encode().split()) for x in part) >= 50):
                    if part in seen:
                        gone |= set(range(i, i + n))
                    seen.add(part)
        kept, at = [], 0
        for x, full in lines:
            if not full or at not in gone:
                kept.append(x)
            at += full
        out[k] = (len(gone), sum(i - 1 not in gone for i in gone), "\n".join(kept) if text is not None else None)
    return out


def test_line_dedup_within_a_text(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\nx\na\nb\nc\n\nd")], "doc_id long, text string")
    r = line_dedup.dedup_lines(df).first()
    assert (r.text, r.n_lines, r.n_removed, r.n_runs) == ("a\nb\nc\nx\n\nd", 8, 3, 1)


@pytest.mark.parametrize("many", [1 << 16, 2])
def test_line_dedup_equals_brute_force(spark, docs, texts, many, monkeypatch):
    monkeypatch.setattr(line_dedup, "FEW", min(many, 256))
    monkeypatch.setattr(line_dedup, "SHARE", 1 << 40)
    rng = np.random.default_rng(8)
    long = [" ".join(f"w{i}" for i in rng.integers(0, 300, n)) for n in (60, 49, 50, 30, 24, 26)]
    rows = [(k, "\n".join(rng.choice(["a", "b", "c", "", "common", *long], rng.integers(0, 9)))) for k in range(150)]
    rows += [(1000 + k, f"only {k}\n{long[0]}\nmore {k}") for k in range(5)] + [(2000 + k, f"only {k}\n{long[3]}\n{long[4]}\n{k}") for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_removed, r.n_runs, r.text) for r in line_dedup.dedup_lines(df).collect()} == lines_removed(rows)
    if many > 2:
        assert {r.doc_id: (r.n_removed, r.n_runs, r.text) for r in line_dedup.dedup_lines(docs).collect()} == lines_removed(sorted(texts.items()))


# op6


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text, add_special_tokens=False).ids, 1]


def check_pieces(df, tokenizer):
    got = packing.pack_documents(df).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    ids = {k: tokenizer(v or "") for k, v in {(r.doc_id, r.text) for r in df.collect()}}
    times = Counter(r.doc_id for r in df.collect())
    for k, parts in pieces.items():
        assert sum(r.length for r in parts) == times[k] * len(ids[k])
        for r in parts:
            part = np.array(ids[k][r.start : r.start + r.length], "<u4").tobytes()
            assert len(part) == 4 * r.length and r.ids_crc32 == zlib.crc32(part) and r.doc_tokens == len(ids[k])
    assert set(pieces) == set(times)
    lengths = [sum(n for _, n in parts) for parts in sequences.values()]
    padding = sum(2048 - n for n in lengths if n & (n - 1))
    assert padding == 0


def test_packing(docs, odd, empty, tokenizer, spark):
    check_pieces(docs, tokenizer)
    check_pieces(odd, tokenizer)
    check_pieces(spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "long words <|endoftext|>" * 30_000), (3, None)], "doc_id long, text string"), tokenizer)
    assert packing.pack_documents(empty).count() == 0


def test_remembered_words_are_the_tokenizers(texts, tokenizer):
    import public_tokenizers

    encode = packing.Ids(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json"))
    odd_ones = [" a  b\n c \n\nd\t e ", "x   y", "é  è z", " ", "a ", "don't 12 345's\n \n x", "", "a \n b", "<|endoftext|> x", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>", "<|endoftext|", "a  <|endoftext|>  b", "​ a　b c"]
    for t in [*texts.values(), *odd_ones]:
        assert np.frombuffer(encode(t), "<u4").tolist() == tokenizer(t)[:-1]


# op7


def as_arrays(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def tree_scores(train, texts, at_once=1 << 17, times=1):
    """Scores of ctw's arrays, without Spark."""
    trained, asked = (ctw.places(*as_arrays(x))[0] for x in (train, texts))
    key, n = ctw.summed(np.concatenate([trained, asked]), np.concatenate([np.full(len(trained), times), np.zeros(len(asked), np.int64)]))
    logs = ctw.log_probabilities(key, n, ctw.Top(*ctw.roots(key, n, at_once)), at_once)
    order = np.argsort(ctw.group_of(key), kind="stable")
    return ctw.score_block(*as_arrays(texts), [logs[order].astype(np.float32).tobytes()])


def tree_by_definition(train, texts, depth=ctw.DEPTH):
    """log10 of P(training texts and a decision) / P(training texts), summed over a text's decisions: each P weighted recursively over dicts."""
    counts, longer, memo = defaultdict(lambda: [0, 0]), defaultdict(set), {}

    def decisions(t):
        s = b"\xff" * depth + t.lower() + b"\xff"
        for i in range(depth, len(s)):
            for bit in range(8):
                yield s[i - depth : i], (bit, s[i] >> (8 - bit)), s[i] >> (7 - bit) & 1

    for t in train:
        for context, node, one in decisions(t):
            for d in range(depth + 1):
                c = context[depth - d :]
                counts[c, node][one] += 1
                if d:
                    longer[c[1:], node].add(c)

    def log_p(c, node, more=None):
        if more is None and (c, node) in memo:
            return memo[c, node]
        a, b = counts.get((c, node), (0, 0))
        if more:
            a, b = a + (not more[1]), b + more[1]
        out = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
        if len(c) < depth:
            along = more and more[0][depth - len(c) - 1 :]
            below = sum(log_p(k, node, more if k == along else None) for k in longer.get((c, node), set()) | ({along} if more else set()))
            top = max(out, below)
            out = math.log(0.5) + top + math.log(math.exp(out - top) + math.exp(below - top))
        if more is None:
            memo[c, node] = out
        return out

    return [sum(log_p(b"", node, (context, one)) - log_p(b"", node) for context, node, one in decisions(t)) / math.log(10) for t in texts]


@pytest.mark.parametrize("at_once", [1, 1 << 17])
def test_context_tree_equals_its_definition(at_once):
    rng = np.random.default_rng(0)
    texts = [bytes(rng.choice(list(b"abc "), rng.integers(0, 40)).tolist()) for _ in range(30)] + [b"", "\u00e9t\u00e9 AB".encode()]
    train = texts[:20] + texts[-2:]
    assert np.allclose(tree_scores(train, texts, at_once), tree_by_definition(train, texts), atol=1e-4)


def test_context_tree_on_spark_equals_its_definition(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(k, "".join(rng.choice(list("abc \n"), rng.integers(0, 30)))) for k in range(60)]
    train = [t.encode() for k, t in rows if not held(k, 1)]
    expect = dict(zip([k for k, _ in rows], tree_by_definition(train, [t.encode() for _, t in rows])))
    got = {r.doc_id: r.score for r in ctw.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got.keys() == expect.keys() and all(math.isclose(got[k], expect[k], abs_tol=1e-4) for k in got)


def test_context_tree_of_all_bytes_is_a_distribution():
    train = [b"abab", b"abc", b"b"]
    key, n = ctw.summed(*(np.concatenate(x) for x in zip(*[(ctw.places(*as_arrays([t]))[0], np.ones(len(t) + 1, np.int64)) for t in train])))
    every = (key[0] >> 8 << 8) + np.arange(256)
    key, n = ctw.summed(np.concatenate([key, every]), np.concatenate([n, np.zeros(256, np.int64)]))
    logs = ctw.log_probabilities(key, n, ctw.Top(*ctw.roots(key, n)))
    assert math.isclose((10 ** logs[np.isin(key, every)]).sum(), 1.0, rel_tol=1e-9)


@pytest.mark.parametrize("times", [1, 10**6, 10**10])
def test_context_tree_of_large_counts(texts, times):
    some = [(t or "").encode() for t in list(texts.values())[:60]]
    got = tree_scores(some[:50], some, times=times)
    assert np.isfinite(got).all() and (got < 0).all()


def test_parts_of_a_block(spark, docs, monkeypatch):
    whole = rows_of(ctw.score(docs).select("doc_id", F.round("score", 3)))
    monkeypatch.setattr(ctw, "BLOCK_BYTES", 20_000)
    assert rows_of(ctw.score(docs.repartition(3)).select("doc_id", F.round("score", 3))) == whole


def test_kt_equals_its_product():
    for a in range(6):
        for b in range(6):
            p, n0, n1 = 1.0, 0, 0
            for bit in [0] * a + [1] * b:
                p *= ((n1 if bit else n0) + 0.5) / (n0 + n1 + 1)
                n0, n1 = n0 + (not bit), n1 + bit
            assert math.isclose(ctw.log_kt(np.array([a]), np.array([b]))[0], math.log(p), abs_tol=1e-8)
    assert np.allclose(ctw.log_kt(np.array([5000, 3]), np.array([2, 9000])), [math.lgamma(5000.5) + math.lgamma(2.5) - math.log(math.pi) - math.lgamma(5003), math.lgamma(3.5) + math.lgamma(9000.5) - math.log(math.pi) - math.lgamma(9004)])


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_unigram_scores(which, request):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in df.collect()]
    c = Counter()
    for k, w in rows:
        if not held(k, 1):
            c.update([*w, None])
    total, kinds = sum(c.values()), len(c)
    expect = sorted((str(k), held(k, 1), len(w) + 1, sum(x in c for x in [*w, None]), total, round(sum(math.log10((c[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in [*w, None]), 6)) for k, w in rows)
    got = ctw.score(df).collect()
    assert expect == sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_context_tree_beats_even_bytes(docs, empty, spark):
    got = ctw.score(docs).where("held_out").agg(F.avg("bits_per_byte")).first()[0]
    assert got < 3.2
    assert ctw.score(empty).count() == 0
    alone = spark.createDataFrame([(i, "ab") for i in range(50) if held(i, 1)], "doc_id long, text string")
    assert all(math.isclose(r.score, 3 * 8 * math.log10(0.5), rel_tol=1e-6) and r.base_score == 3 * math.log10(0.5 / 0.5) for r in ctw.score(alone).collect())


# op8


def covered(rows):
    """(n_bytes, n_removed, n_spans, kept) of texts in the order of their ids."""
    seen, out = set(), {}
    for k, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            else:
                seen.add(raw[i : i + 100])
        out[k] = (len(raw), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), bytes(b for b, g in zip(raw, gone) if not g))
    return out


@pytest.mark.parametrize("bucket", [4096, 1])
def test_suffix_dedup_equals_brute_force(docs, texts, bucket, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == covered(sorted(texts.items()))


def test_suffix_dedup_of_odd_rows(odd, empty):
    rows = {(r.doc_id, r.text) for r in odd.collect()}
    expect = covered(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))
    got = suffix_dedup.remove_repeats(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == expect[r.doc_id]
    assert suffix_dedup.remove_repeats(empty).count() == 0


# op9


def test_license_join_equals_brute_force(odd, empty, spark):
    import re

    grant, apache = license_join.NOTICES["mit-grant"], license_join.NOTICES["apache-2.0"]
    made = {
        1: grant.replace("any person", "any\n  person"),
        2: "// " + "\n// ".join(grant.split()),
        3: " ".join(f"{w} {'x ' * 30}" for w in grant.split()) * 3,  # one long line, its words scattered
        4: " ".join(grant.split()[:16]),
        5: "a b c " * 3000 + grant + " d e f" * 3000,
        6: "license mit license apache " * 2000,
        7: " ".join(reversed(apache.split())) + " and the Apache\nLicense",
        8: "released under the mit",
        9: "mit",
        10: apache.replace("version", "version number of all") + ".",
    }
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    seen = {}
    for rows in (odd, df):
        got = license_join.scan(rows).collect()
        assert len(got) == rows.count()
        texts_by = {r.doc_id: r.text or "" for r in rows.collect()}
        for r in got:
            w = words_of(texts_by[r.doc_id])
            starts, base, labels, score = [], set(), set(), 0.0
            for phrase, label in license_join.PHRASES.items():
                p = phrase.split()
                own = [i for i in range(len(w)) if w[i : i + len(p)] == p]
                starts += own
                base |= {label} if own else set()
            for label, notice in license_join.NOTICES.items():
                own, width = set(notice.split()), math.ceil(len(notice.split()) / 0.8)
                share = max(len(own & set(w[i : i + width])) / len(own) for i in range(max(1, len(w) - width + 1)))
                if share >= 0.8:
                    labels.add(label)
                    score = max(score, share)
            assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(starts), min(starts, default=None), max(starts, default=None))
            assert r.base_labels == ",".join(sorted(base)) and r.labels == ",".join(sorted(base | labels)) and math.isclose(r.score, 1.0 if base else score)
            seen[r.doc_id] = r.labels
    assert seen[1] == seen[2] == seen[5] == "mit-grant" and seen[3] == "" and "apache" in seen[7]
    assert license_join.scan(empty).count() == 0


# op10


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 64))
    x[100:200] = x[:100] + 0.25 * rng.standard_normal((100, 64))
    x[200:210] = x[0]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(1000, None, 1), (1001, [0.0] * 64, 1), (1002, [float("nan")] * 64, 1), (1003, [None, *[1.0] * 63], 1), (1004, [float("inf")] * 64, 1), (1005, [], 1), (1006, [1.0, 2.0], 1), (None, x[0].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cap int")
    got = {r.vec_id: r for r in cap_filters.near_vectors(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    found, true = sum(got[i].n_links for i in range(300)), near.sum() - 300
    assert len(got) == len(rows) and 0.9 * true <= found <= true
    assert all(got[i].n_links <= near[i].sum() - 1 for i in range(300))
    assert got[205].component_id == 0 and not got[205].kept and got[205].n_links >= 10
    for k in range(1000, 1007):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert cap_filters.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("group", [16, 512])
def test_hot_vectors_in_groups(spark, group):
    rng = np.random.default_rng(4)
    base = rng.standard_normal(64)
    x = base + 0.05 * rng.standard_normal((120, 64))
    x[100:] = x[:20]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    classes, degrees, edges = cap_filters.link(df, group=group)
    assert classes.count() == 100 and {(r.members, r.others) for r in classes.join(degrees, "__rep").collect()} == {(1, 119), (2, 118)}
    assert edges.count() < 100 * 40 * 8 and {r.component for r in components.components(edges).collect()} == {0}


@pytest.mark.parametrize("dim", [1, 2, 3, 4, 8, 12, 16, 24, 32, 64, 256, 1024])
def test_recall_by_components(dim):
    rng = np.random.default_rng(5)
    x, z = (cap_filters.unit(rng.standard_normal((1500, dim))) for _ in range(2))
    if dim > 1:
        z = cap_filters.unit(z - (z * x).sum(axis=1, keepdims=True) * x)
        y = 0.901 * x + math.sqrt(1 - 0.901**2) * z
    else:
        y = x
    codes, bound = cap_filters.filters(dim, 0.9)
    met, own = np.zeros(len(x), bool), 0
    for one in codes:
        (a, f), (b, g) = (cap_filters.decode(v, one, bound) for v in (x, y))
        met[[i for i, _ in set(zip(a.tolist(), f.tolist())) & set(zip(b.tolist(), g.tolist()))]] = True
        own += len(a) / len(x)
    assert met.mean() >= 0.99 and own < 60


@pytest.mark.parametrize("dim", [1, 2, 5, 8])
def test_vectors_of_few_components(spark, dim):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((150, dim))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = ((u @ u.T) >= 0.9).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in cap_filters.near_vectors(df).collect()}
    assert all(got[i] <= true[i] for i in got) and sum(got.values()) >= 0.99 * true.sum()


def test_components(spark):
    path = [(i, i + 1) for i in range(0, 60)] + [(100, 103), (103, 101), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 103: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# pipeline


def test_pipeline(spark, docs):
    rows, kept = docs, {r.doc_id for r in docs.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_copies", "mix", "pack"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = spark.createDataFrame(stage(spark, rows, DATA).collect(), docs.schema)
        assert rows.columns == docs.columns
        now = {r.doc_id for r in rows.select("doc_id").collect()}
        assert now <= kept
        if name == "near_copies":
            classes = order_minhash.near_duplicates(rows)
            assert classes.where("not kept").count() == 0
        kept = now
    tokens = lambda df: rows_of(df.groupBy("doc_id").agg(F.sum("length")))
    assert tokens(corpus_pipeline.run(spark, DATA)) == tokens(packing.pack_documents(rows))


def test_stages_of_odd_rows(spark, odd, empty):
    """Nulls, empty texts, ties, repeated rows and clashing columns in each stage."""
    rows = odd.collect()
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, DATA)
        if name != "pack":
            assert got.columns == corpus_pipeline.COLUMNS
        got = got.collect()
        assert stage(spark, empty, DATA).count() == 0
        if name == "language":
            assert {(r.doc_id, r.text) for r in got} <= {(r.doc_id, r.text) for r in rows if r.text and any(c.isalpha() for c in r.text)}
            assert {2, 3, 4} <= {r.doc_id for r in got}
        elif name == "lines":
            want = lines_removed(sorted({(r.doc_id, r.text) for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0)))
            for r in got:
                assert r.text == want[r.doc_id][2] and r.n_chars == (None if r.text is None else len(r.text))
            assert {r.doc_id for r in got} == {k for k, v in want.items() if v[0] == 0 or (v[2] and v[2].strip())}
        elif name == "near_copies":
            assert Counter(r.doc_id for r in got) == Counter({k: 1 for k in [None, 1, 2, 5, 6, 7, 8, 9, 10, 11, 12, *([3] if not order_minhash.similar((rows[1].text or "").split(), (rows[2].text or "").split()) else [])]})
        elif name == "mix":
            times = Counter((r.doc_id, r.text) for r in got)
            before = Counter((r.doc_id, r.text) for r in rows)
            assert all(times[k] <= 2 * before[k] for k in times) and set(times) <= set(before)
        else:
            assert {r.doc_id for r in got} == {r.doc_id for r in rows} and min(r.length for r in got) > 0


def test_language_stage_keeps_clean_documents(spark, docs):
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, DATA).select("doc_id").collect()}
    told = docs.where(F.col("lang").isNotNull() & (F.length("text") > 200)).select("doc_id").collect()
    assert sum(r.doc_id in kept for r in told) / len(told) > 0.99


def test_sha_is_of_the_kept_bytes(spark, texts):
    got = {r.doc_id: r.kept_sha256 for r in registry.op8_suffix_buckets(spark, DATA).collect()}
    expect = covered(sorted(texts.items()))
    assert got == {k: hashlib.sha256(v[3]).hexdigest() for k, v in expect.items()}
