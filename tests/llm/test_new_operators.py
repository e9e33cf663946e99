"""Lexical search, source audit and decontamination against brute force, on small tables with nulls, ties, repeats and odd columns."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm import fm_index, registry, source_audit, tput
from siltstone.llm.tokens import byte_blocks, split_words

from .test_llm import DATA, DOCS, odd_rows

ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("row", T.StringType()), T.StructField("key", T.StringType()), T.StructField("score", T.StringType())])
PASSAGE = "The quick brown fox jumps over the lazy dog and then it runs away from the farm"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def word_list(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def item_rows():
    return [
        (1, PASSAGE, "a", "b", "c"),
        (1, PASSAGE, "a", "b", "c"),
        (2, "mit licence", None, None, None),
        (3, None, None, None, None),
        (4, " .,", None, None, None),
        (10, "été à la plage où les élèves sont allés et", None, None, None),
        (None, "an item of nobody", None, None, None),
        (5, "nowhere to be found in any of these documents at all, not even once", None, None, None),
        (6, "long words of no end long words of no end long", None, None, None),
        (7, "MIT License. mit license", None, None, None),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(item_rows(), ITEMS)


@pytest.fixture(scope="module")
def no_items(spark):
    return spark.createDataFrame([], ITEMS)


def test_words_of_a_class():
    texts = ["Ab-c9é", None, "", "x", "y z\x00\x7f", "..", "end"]
    found, at = split_words(pa.array(texts))
    got = [[w.decode() for w in found[at[i] : at[i + 1]].to_pylist()] for i in range(len(texts))]
    assert got == [word_list(t) for t in texts]
    data = np.frombuffer(b"abc defghij k  lm", np.uint8)
    assert [b.tobytes() for b in byte_blocks(data, 4)] == [b"abc defghij", b" k  lm"]


# --- lexical search


def best(docs, items, k):
    """item -> [(doc_id, score)] by the definition."""
    held = [(d, Counter(word_list(t)), len(word_list(t))) for d, t in docs]
    held = [(d, c, n) for d, c, n in held if n]
    n_docs, total = len(held), sum(n for *_, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = {}
    for item, text in {(i, t) for i, t in items if i is not None and t is not None}:
        scores = out.setdefault(item, Counter())
        for w, times in Counter(word_list(text)).items():
            weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
            for r, (_, c, n) in enumerate(held):
                if c[w]:
                    scores[r] += times * weight * ((1000000000 * c[w]) // (1000 * c[w] + 12 * (75 + (25 * n * n_docs) // total)))
    rank = lambda s: sorted(((held[r][0], v) for r, v in s.items() if v > 0), key=lambda x: (-x[1], x[0] is None, x[0] or 0))[:k]
    return {i: r for i, s in out.items() if (r := rank(s))}


def found(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["item_id"], r["rank"])):
        assert r["rank"] == len(out[r["item_id"]]) + 1
        out[r["item_id"]].append((r["doc_id"], r["score"]))
    return dict(out)


@pytest.mark.parametrize(("k", "head"), [(20, 256), (2, 1), (1, 3)])
def test_search_equals_brute_force(odd, items, k, head):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found(tput.search(odd, items, k, head)) == best(docs, [r[:2] for r in item_rows()], k)


def test_search_of_nothing(odd, items, empty, no_items):
    assert tput.search(odd, no_items).count() == 0
    assert tput.search(empty, items).count() == 0
    assert tput.search(odd.where("text IS NULL"), items).columns == ["item_id", "rank", "doc_id", "score"]


def test_search_with_lists_in_parts_and_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(tput, "PART", 7)
    monkeypatch.setattr(tput, "BROADCAST", -1)
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(40)]
    odds = 1 / np.arange(1, 41)
    text = lambda n: " ".join(rng.choice(vocabulary, n, p=odds / odds.sum()))
    docs = [(i, text(rng.integers(1, 60))) for i in range(150)]
    docs += [(200 + i, docs[3][1]) for i in range(30)]  # ties
    items = [(i, text(12)) for i in range(8)]
    got = tput.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 5, 4)
    assert found(got) == best(docs, items, 5)


def test_only_what_can_be_among_the_best_is_looked_up(spark):
    """A word that all documents hold is fetched by no threshold, and few documents are left for the last round."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the word "), F.when(F.col("id") % 40 == 0, "rare ruby"), F.lit(" x"), F.col("id")).alias("text"))
    docs = docs.withColumn("text", F.coalesce("text", F.concat(F.lit("the word y"), F.col("doc_id"))))
    asked = tput.item_terms(spark.createDataFrame([(1, "the rare ruby word")], "item_id long, text string"))
    entries = tput.lists(docs, asked)
    assert entries.where("term = 'the'").count() in (0, 2000)
    assert tput.candidates(entries, asked).count() == 50


# --- source audit


def audit_by_definition(rows, least, most):
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x60\x7B-\x7F]+", low(text))) for lang, source, text in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        df = Counter(w for r in mine for w in set(r[2]))
        kept = {w for w, n in df.items() if n >= least}
        counts = {s: Counter(w for r in mine if r[1] == s for w in r[2] if w in kept) for s in {r[1] for r in mine}}
        total = sum(counts.values(), Counter())

        def shares(c, kept=kept):
            below = sum(c.values()) + 5 * len(kept)
            return {w: 1 + 10**9 * (c[w] + 5) // below for w in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(total)
        for s in counts:
            pairs = [(t, sum(abs(p[s][w] - p[t][w]) for w in kept)) for t in counts if t != s]
            terms = [(w, p[s][w] - q[w]) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, most)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out |= {(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("block", [256, 2])
def test_audit_equals_its_definition(spark, docs_rows, monkeypatch, block):
    monkeypatch.setattr(source_audit, "BLOCK", block)
    rows = [*docs_rows, ("xx", "only", "no kept term"), ("xx", None, None), (None, "s", "a a a b"), (None, "t", "a b c"), (None, None, "")]
    got = source_audit.audit(spark.createDataFrame(rows, "lang string, source string, text string").repartition(5), 2, 4)
    assert {tuple(r) for r in got.collect()} == audit_by_definition(rows, 2, 4)


@pytest.fixture(scope="module")
def docs_rows():
    return duckdb.sql(f"SELECT lang, source, left(text, 600) FROM '{DATA}/documents.parquet' WHERE doc_id < 60").fetchall()


def test_audit_of_odd_rows(odd, empty):
    rows = [(r["lang"], r["source"], r["text"]) for r in odd.collect()]
    got = source_audit.audit(odd, 1).collect()
    assert {tuple(r) for r in got} == audit_by_definition(rows, 1, 50) and len(got) == len(set(got))
    assert source_audit.audit(empty).count() == 0


def test_shares_of_large_counts(spark):
    got = spark.range(1).select(source_audit.share(F.lit(4 * 10**15), F.lit(9 * 10**17), F.lit(10**7)).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (4 * 10**15 + 5) // (9 * 10**17 + 5 * 10**7)


# --- decontamination


def test_suffix_order():
    rng = np.random.default_rng(0)
    for _ in range(100):
        marks = rng.integers(1, 5)
        s = np.concatenate([np.append(rng.integers(0, 3, rng.integers(0, 40)) + marks, i) for i in range(marks)]).astype(np.int64)
        assert fm_index.suffix_order(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    for symbols in (1, 2, 5, 64, 129):
        s = rng.integers(0, symbols, 200)
        smaller = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=symbols))])
        w = fm_index.Wavelet(fm_index.Wavelet.levels(s, symbols), len(s), smaller)
        for i in range(0, 201, 7):
            assert w.rank(np.arange(symbols), np.full(symbols, i)).tolist() == [(s[:i] == c).sum() for c in range(symbols)]
        at = np.arange(200)
        symbol, before = w.step(at)
        assert symbol.tolist() == s.tolist() and before.tolist() == [(s[:i] == s[i]).sum() for i in range(200)]


def leaks(docs, items, window):
    """[(doc_id, n_words, n_hit, items)] by the definition."""
    runs = defaultdict(set)
    for item, text in items:
        w = word_list(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            runs[tuple(w[i : i + window])].add(item)
    out = []
    for doc, text in docs:
        w, hit, held = word_list(text), set(), set()
        for size in {len(r) for r in runs}:
            for i in range(len(w) - size + 1):
                if (run := tuple(w[i : i + size])) in runs:
                    hit |= set(range(i, i + size))
                    held |= runs[run]
        out.append((doc, len(w), len(hit), sorted(str(i) for i in held if i is not None)))
    return sorted(out, key=repr)


def summary(df):
    rows = df.collect()
    for r in rows:
        covered = {i for s in r["spans"] for i in range(s["start"], s["end"])}
        assert len(covered) == r["n_hit"] and all(0 <= i < r["n_words"] for i in covered)
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in rows), key=repr)


@pytest.mark.parametrize(("shard", "round_bytes"), [(8 << 20, 32 << 20), (300, 32 << 20), (2000, 100)])
def test_decontaminate_equals_brute_force(spark, odd, items, shard, round_bytes):
    more = [(100 + i, t) for i, t in enumerate([PASSAGE, "x " + PASSAGE.lower().replace(" ", ", ") + " y", PASSAGE[:60], PASSAGE + " " + PASSAGE, ("pad " * 150 + PASSAGE + " ") * 3, "mit licence mit licence", "the mit", "licence"])]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    want = leaks([tuple(r) for r in docs.collect()], [r[:2] for r in item_rows()], 10)
    assert summary(fm_index.decontaminate(docs, items, shard_bytes=shard, round_bytes=round_bytes)) == want


def test_decontaminate_odd_tables(odd, items, empty, no_items):
    assert {r["n_hit"] for r in fm_index.decontaminate(odd, no_items).collect()} == {0}
    assert fm_index.decontaminate(empty, items).count() == 0
    assert fm_index.decontaminate(odd, items).count() == len(odd_rows())


def test_a_kept_index_is_searched_again(spark, tmp_path):
    docs = spark.createDataFrame([(1, PASSAGE), (2, "other words")], "doc_id long, text string")
    fm_index.build(docs).write.parquet(str(tmp_path / "shards"))
    shards = spark.read.parquet(str(tmp_path / "shards"))
    for text, n in ((PASSAGE, 1), ("other words", 1), ("words other", 0)):
        wanted = fm_index.windows(spark.createDataFrame([(1, text)], "item_id long, text string"))
        assert fm_index.search(shards, wanted).where("size(items) > 0").count() == n


def test_sha_of_no_items(spark):
    row = registry.QUERIES["op13_fm_index"](spark, DATA).where("NOT contaminated").first()
    assert row["items_sha256"] == hashlib.sha256(b"").hexdigest() and row["n_items"] == 0


def test_postings_go_once_the_lists_are_written(spark, monkeypatch):
    """They would take disk until the application ends."""
    from siltstone.llm import tput

    gone, discard = [], tput.discard
    monkeypatch.setattr(tput, "discard", lambda *tables: (gone.extend(t.cut_path for t in tables), discard(*tables)))
    docs = spark.createDataFrame([(1, "a b"), (2, "b b c")], "doc_id long, text string")
    asked = tput.item_terms(spark.createDataFrame([("x", "b c")], "item_id string, text string"))
    assert tput.lists(docs, asked).count() == 3 and len(gone) == 1
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(gone[0])
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
