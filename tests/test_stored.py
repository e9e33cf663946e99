"""States of tables, and the indexes that are kept in them."""

import collections
import pathlib
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import parse, stems
from siltstone.operators import search, text_index, vector_index
from siltstone.plans import catalogue
from siltstone.sources import tables


def files(root):
    return {p: p.stat().st_size for p in pathlib.Path(root[7:]).rglob("*.parquet")}


def frame(spark, rows):
    return spark.createDataFrame(rows, "source_url string, x int")


def content(spark, root, name="t", number=None):
    return sorted(map(tuple, tables.read_table(spark, root, name, number).collect()), key=repr)


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/t"


def test_commits_write_only_what_they_touch(spark, root):
    tables.write_tables(spark, root, {"t": frame(spark, [(f"s{i}", i) for i in range(20_000)]).repartition(4), "log": spark.range(3)}, "source_url")
    before = files(root)
    assert tables.commit(spark, root, {"t": frame(spark, [("s1", -1), ("new", 5), (None, 6)])}, frame(spark, [("s1", 0), ("s2", 0), ("new", 0)])) == 2
    new = files(root).keys() - before.keys()
    assert sum(files(root)[p] for p in new) < sum(before.values()) / 10
    got = dict(content(spark, root))
    assert got["s1"] == -1 and "s2" not in got and got["new"] == 5 and got[None] == 6 and len(got) == 20_001
    assert len(content(spark, root, number=1)) == 20_000 and tables.read_table(spark, root, "log").count() == 3
    tables.commit(spark, root, {"t": frame(spark, [])}, frame(spark, [(None, 0)]))
    assert None not in dict(content(spark, root))


def test_keys_of_one_table_only(spark, root):
    tables.write_tables(spark, root, {"t": frame(spark, [("a", 1)]), "u": frame(spark, [("a", 1)])}, "source_url")
    tables.commit(spark, root, {"u": frame(spark, [("a", 2)])}, {"u": frame(spark, [("a", 0)])})
    assert content(spark, root) == [("a", 1)] and content(spark, root, "u") == [("a", 2)]


def test_two_writers_of_one_state(spark, root):
    tables.write_tables(spark, root, {"t": frame(spark, [("a", 1), ("b", 1)])}, "source_url")
    write = lambda k, x: tables.commit(spark, root, {"t": frame(spark, [(k, x)])}, frame(spark, [(k, 0)]), base=1)
    assert write("a", 2) == 2
    assert write("b", 3) == 3  # another key: it goes after
    with pytest.raises(tables.Conflict):
        write("a", 9)
    with pytest.raises(tables.Conflict):
        tables._commit(spark, root, 1, lambda before, n: before, lambda other: True)
    assert content(spark, root) == [("a", 2), ("b", 3)]


def test_writers_at_once(spark, root):
    tables.write_tables(spark, root, {"t": frame(spark, [])}, "source_url")
    ended, start = [], threading.Barrier(4)

    def work(i):
        df, key = frame(spark, [(f"k{i // 2}", i)]), frame(spark, [(f"k{i // 2}", 0)])
        start.wait()
        try:
            ended.append(tables.commit(spark, root, {"t": df}, key, base=1))
        except tables.Conflict:
            ended.append(None)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(4)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert sorted(x for x in ended if x) == [2, 3] and ended.count(None) == 2
    assert [k for k, _ in content(spark, root)] == ["k0", "k1"]


def test_a_replacement_conflicts(spark, root, monkeypatch):
    tables.write_tables(spark, root, {"t": frame(spark, [("a", 1)])})
    publish, n = tables._publish, []

    def slow(spark_, root_, number, state):
        if not n:  # another writer is faster
            n.append(1)
            tables.write_tables(spark, root, {"t": frame(spark, [("a", 2)])})
        return publish(spark_, root_, number, state)

    monkeypatch.setattr(tables, "_publish", slow)
    with pytest.raises(tables.Conflict):
        tables.write_tables(spark, root, {"t": frame(spark, [("a", 3)])})
    assert content(spark, root) == [("a", 2)]


def test_a_killed_writer_and_a_long_reader(spark, root):
    tables.write_tables(spark, root, {"t": frame(spark, [("a", 1)])}, "source_url")
    reader = tables.read_table(spark, root, "t")
    with pytest.raises(Exception, match="no"):  # killed while it writes
        tables.commit(spark, root, {"t": frame(spark, [("a", 2)]), "u": spark.range(1).select(F.raise_error(F.lit("no")).alias("x"))}, frame(spark, [("a", 0)]))
    assert content(spark, root) == [("a", 1)]
    for x in range(3):
        tables.commit(spark, root, {"t": frame(spark, [("a", x)])}, frame(spark, [("a", 0)]))
    assert tables.merge(spark, root) == 5 and content(spark, root) == [("a", 2)]
    assert tables.clean(spark, root, keep=5) == []  # within the time of grace
    assert len(tables.clean(spark, root, keep=5, grace_seconds=0)) == 1  # what the killed writer left
    assert [tuple(r) for r in reader.collect()] == [("a", 1)]
    assert len(tables.clean(spark, root, keep=1, grace_seconds=0)) == 4 and content(spark, root) == [("a", 2)]


def test_a_merge_and_commits_meanwhile(spark, root, monkeypatch):
    tables.write_tables(spark, root, {"t": frame(spark, [("a", 1), ("b", 1)])}, "source_url")
    tables.commit(spark, root, {"t": frame(spark, [("a", 2)])}, frame(spark, [("a", 0)]))
    read = tables.read_table

    def meanwhile(*args):
        out = read(*args)
        monkeypatch.setattr(tables, "read_table", read)
        tables.commit(spark, root, {"t": frame(spark, [("b", 7)])}, frame(spark, [("b", 0)]))
        return out

    monkeypatch.setattr(tables, "read_table", meanwhile)
    tables.merge(spark, root)
    assert content(spark, root) == [("a", 2), ("b", 7)]
    state = tables.state_of(spark, root, tables.current(spark, root))
    assert len(state["tables"]["t"]["segments"]) == 2 and len(state["voids"]) == 1


# --- tokens


@pytest.mark.parametrize(
    "run,expect",
    [
        ("word", "word:word"),
        ("Élève", "word:Élève"),
        ("H1B", "numword:H1B"),
        ("2nd", "numword:2nd"),
        ("well-known", "hword:well-known part:well part:known"),
        ("F-1-visa", "numhword:F-1-visa part:F uint:1 part:visa"),
        ("i-20s", "numhword:i-20s part:i numpart:20s"),
        ("www.a-b.org", "host:www.a-b.org"),
        ("https://a.org/x?y=1#z", "protocol:https:// url:a.org/x?y=1#z host:a.org path:/x?y=1#z"),
        ("(see", "word:see"),
        ("a.b_c@mail.example.com,", "host:a.b email:c@mail.example.com"),
        ("user.name@a-b.org)", "email:user.name@a-b.org"),
        ("3.11.2", "version:3.11.2"),
        ("1,000", "uint:1 uint:000"),
        ("-5", "int:-5"),
        ("a-5", "word:a uint:5"),
        ("2026-09-15", "uint:2026 uint:09 uint:15"),
        ("3.14", "float:3.14"),
        ("end.", "word:end"),
        ("...", ""),
        ("", ""),
        ("x@", "word:x"),
        ("10:30", "uint:10 uint:30"),
        ("don't", "word:don word:t"),
    ],
)
def test_tokens(run, expect):
    assert " ".join(f"{k}:{t}" for k, t in parse.tokens_of(run)) == expect


def test_tokens_never_span_and_cover(spark):
    texts = ["The well-known F-1 visa\tcosts $1,000.50 at https://a.org/x", None, "", "mail me@x.org or 1.2.3 \n running runs"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = parse.typed_tokens(docs, "id", "text", search.STOP_WORDS).orderBy("id", "run", "at").collect()
    want = [(i, n, at, k, t, parse.lexeme(k, t, frozenset(search.STOP_WORDS))) for i, x in enumerate(texts) for n, r in enumerate((x or "").split()) for at, (k, t) in enumerate(parse.tokens_of(r))]
    assert [tuple(r) for r in rows] == want
    assert [r["lexeme"] for r in rows if r["id"] == 3][-2:] == ["run", "run"] and stems.stem("running") == "run"


# --- the text index


def chunk_frame(spark, rows):
    return spark.createDataFrame(rows, "id long, source_url string, heading string, content string")


def words_of(rng, n):
    odds = 1 / np.arange(1, 61)
    return " ".join(f"w{i}" for i in rng.choice(60, n, p=odds / odds.sum()))


def made(rng, n=300, first=0):
    return [(first + i, f"s{i % 7}", words_of(rng, 3) if i % 5 else None, words_of(rng, int(rng.integers(1, 80))) if i % 11 else None) for i in range(n)]


@pytest.mark.parametrize("block", [128, 4])
def test_index_ranks_as_all_texts_do(spark, root, monkeypatch, block):
    monkeypatch.setattr(text_index, "BLOCK", block)
    monkeypatch.setattr(text_index, "PROBED", 3)
    direct = {128: 0, 4: 1 << 20}[block]  # by rounds, and without
    rng = np.random.default_rng(block)
    rows = made(rng)
    asked = spark.createDataFrame([(i, words_of(rng, 4)) for i in range(12)] + [(50, "the of"), (51, None), (52, "nowhere")], "query_id long, text string")
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
    plain = lambda rows: search.keyword_rank(chunk_frame(spark, rows), asked, 6)
    text_index.build(spark, root, chunk_frame(spark, rows))
    assert same(plain(rows), text_index.rank(spark, root, asked, 6, direct=0)) and same(plain(rows), text_index.rank(spark, root, asked, 6))
    new = [r for r in made(rng, 60, 1000) if r[1] in ("s2", "s3")]
    text_index.replace(spark, root, chunk_frame(spark, new), spark.createDataFrame([("s2",), ("s3",), ("s9",)], "source_url string"))
    now = [r for r in rows if r[1] not in ("s2", "s3")] + new
    assert same(plain(now), text_index.rank(spark, root, asked, 6, direct=direct)) and same(plain(rows), text_index.rank(spark, root, asked, 6, 1, 0))
    text_index.merge(spark, root)
    assert same(plain(now), text_index.rank(spark, root, asked, 6, direct=0))
    read = tables.read_table(spark, root, "postings")
    assert read.columns[:3] == ["lexeme", "source_url", "id"] and all("/postings" in f for f in read.inputFiles())  # no text is kept, or read


def test_english_index(spark, root):
    rows = [(1, "a", "Running visas", "the well-known students ran"), (2, "b", None, "a visa for a student at a.org/visa"), (3, "c", "x", "well known"), (4, None, "visas", None)]
    text_index.build(spark, root, chunk_frame(spark, rows), "english")
    asked = spark.createDataFrame([(1, "runs"), (2, "student's visa"), (3, "well-known"), (4, "A.org"), (5, "the")], "query_id long, text string")
    got = collections.defaultdict(list)
    for r in text_index.rank(spark, root, asked).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["id"], r["score"]))
    assert got == {1: [(1, 1.0)], 2: [(1, 1.4), (4, 1.0), (2, 0.8)], 3: [(1, 1.2), (3, 0.8)], 4: [(2, 0.4)]}


def test_a_common_lexeme_is_read_within_bounds(spark, root, monkeypatch):
    """Of a word that all rows hold, blocks that can't bring a row in aren't candidates."""
    monkeypatch.setattr(text_index, "BLOCK", 16)
    rows = spark.range(4000).select("id", F.lit("s").alias("source_url"), F.lit("h").alias("heading"), F.concat(F.repeat(F.lit("common "), F.when(F.col("id") % 100 == 7, 9).otherwise(1)), F.when(F.col("id") % 200 == 9, "rare rare rare rare").otherwise("")).alias("content"))
    text_index.build(spark, root, rows)
    asked = spark.createDataFrame([(1, "common"), (2, "common rare")], "query_id long, text string")
    lists = text_index.Lists(spark, root, asked)
    n = {r["query_id"]: r["count"] for r in lists.candidates(5).groupBy("query_id").count().collect()}
    assert n[1] <= 40 and n[2] <= 60
    assert [r["id"] for r in lists.rank(5, 0).where("query_id = 1").orderBy("rank").collect()] == [7, 107, 207, 307, 407]


@pytest.mark.parametrize("small", [False, True])
def test_sums_by_documents_equal_plain_counts(spark, root, monkeypatch, small):
    """Against counts in Python, also in many rounds of small parts; an index is built without a shuffle."""
    if small:
        monkeypatch.setattr(search, "ROUND", 300)
        monkeypatch.setattr(search, "PAIRS", 7)
        monkeypatch.setattr(search, "ENTRIES", 5)
        monkeypatch.setattr(text_index, "PART", 50)
    rng = np.random.default_rng(3)
    rows = made(rng, 80) + [(5, "again", "w1 w1", "w2 the"), (None, "s", "w3", "w1")]
    asked = [(i - 2, words_of(rng, 5)) for i in range(9)] + [(100, "the"), (101, None), (102, "w1 W1")]
    want = []
    for q, text in asked:
        found = collections.Counter()
        for w in {x.lower() for x in (text or "").split()} - set(search.STOP_WORDS):
            for i, _, h, c in rows:
                if n := 5 * (h or "").split().count(w) + 2 * (c or "").split().count(w):
                    found[i] += n
        best = sorted(found.items(), key=lambda x: (-x[1], -1 if x[0] is None else x[0]))[:4]
        want += [(q, i, n / 5, r + 1) for r, (i, n) in enumerate(best)]
    chunks, questions = chunk_frame(spark, rows), spark.createDataFrame(asked, "query_id long, text string")
    got = lambda df: sorted(map(tuple, df.select("query_id", "id", "score", "rank").collect()), key=repr)
    assert "Exchange" not in text_index.postings(chunks)._jdf.queryExecution().executedPlan().toString()
    text_index.build(spark, root, chunks)
    assert got(text_index.rank(spark, root, questions, 4)) == sorted(want, key=repr)
    assert got(search.keyword_rank(chunks, questions, 4)) == sorted(want, key=repr)


# --- the vector index


def vector_frame(spark, x, source=lambda i: f"s{i % 5}"):
    return spark.createDataFrame([(i, source(i), None if v is None else [float(c) for c in v]) for i, v in enumerate(x)], "id long, source_url string, embedding array<double>")


def test_vector_index_equals_all_pairs(spark, root):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 8)) * 4
    x = [*(centres[rng.integers(0, 12, 600)] + rng.normal(size=(600, 8)) * 0.3), None, [], [0.0] * 8, [float("nan")] * 8, [1.0, 2.0], [2.0, 1.0]]
    x += x[:40]  # ties
    vectors = vector_frame(spark, x)
    asked = vectors.where("id % 20 = 0 OR size(embedding) = 2").select(F.col("id").alias("query_id"), "embedding")
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
    vector_index.build(spark, root, vectors)
    index = vector_index.Index(spark, root)
    assert same(search.nearest(vectors, asked, 7), index.nearest(asked, 7))
    assert index.read_share(asked, 7) < 0.5
    new = vector_frame(spark, list(rng.normal(size=(50, 8))), lambda i: "s3").withColumn("id", F.col("id") + 5000)
    vector_index.replace(spark, root, new, new.select("source_url"))
    now = vectors.where("source_url <> 's3'").unionByName(new)
    assert same(search.nearest(now, asked, 7), vector_index.Index(spark, root).nearest(asked, 7))
    assert same(search.nearest(vectors, asked, 7), vector_index.Index(spark, root, 1).nearest(asked, 7))


def test_nearest_by_small_blocks_on_even_vectors(spark, root, monkeypatch):
    """Blocks are bounded in bytes, a task keeps k rows of a question over all its blocks, and pairs of questions and clusters aren't kept."""
    for name, n in (("BYTES", 64 * 16), ("CELLS", 40), ("KEPT", 60)):
        monkeypatch.setattr(search, name, n)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 16))
    x[7] = x[3]  # a tie
    vectors = vector_frame(spark, list(x))
    asked = vectors.where("id % 20 = 0 OR id = 3").select(F.col("id").alias("query_id"), "embedding")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    far = np.round(1 - unit @ unit.T, 9) + 0.0
    want = {q: np.lexsort((np.arange(500), far[q]))[:6].tolist() for q in [*range(0, 500, 20), 3]}
    got = lambda df: {q: [i for _, i in sorted(v)] for q, v in df.groupBy("query_id").agg(F.collect_list(F.struct("rank", "id"))).collect()}
    blocks = search.packed(vectors, "id", None, search.ROWS).select(F.max(F.octet_length("x")), F.count("*")).first()
    assert blocks[0] <= 64 * 16 and blocks[1] > 60
    assert got(search.nearest(vectors, asked, 6)) == want
    vector_index.build(spark, root, vectors)
    index = vector_index.Index(spark, root)
    assert got(index.nearest(asked, 6)) == want
    assert index.visits(asked, 6, first_only=True).count() < index.visits(asked, 6).count() / 4


def test_both_arms_are_ranked_once(spark):
    """Companions and counts are made of candidates that are written, not ranked again for each use."""
    plan = catalogue.fused(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Exchange" not in plan


def test_vector_index_of_nothing(spark, root):
    vectors = vector_frame(spark, [None])
    vector_index.build(spark, root, vectors)
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, embedding array<double>")
    assert vector_index.Index(spark, root).nearest(asked).count() == 0


def test_block_pairs_are_dealt_out(spark):
    x = np.random.default_rng(2).normal(size=(300, 4))
    asked = vector_frame(spark, list(x)).select(F.col("id").alias("query_id"), "embedding").repartition(6)
    got = search.pair_distances(asked).first()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    far = (1 - unit @ unit.T)[np.triu_indices(300, 1)]
    assert got["pairs"] == len(far) and np.allclose([got["least"], got["mean"], got["most"]], [far.min(), far.mean(), far.max()])
