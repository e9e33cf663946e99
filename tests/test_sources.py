"""Files that rows come from and go to."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from siltstone.functions import prose
from siltstone.operators import ingest, refresh
from siltstone.sources import crawl, golden, manifest, snapshots, tables

MANIFEST = """sources:
- url: https://a.org/x
  title: A
  topic: t
  annotations: {rule_effective_date: 2026-09-15, rule_status: enjoined, rule_status_source: https://c, rule_status_source_evidences_status: true}
- url: https://b.org/y
  title: B
  topic: t
- url: https://c.org/z
  topic: u
  annotations: {rule_status: null, rule_status_source_evidences_status: "maybe"}
"""


def test_manifest(spark, tmp_path):
    (tmp_path / "m.yaml").write_text(MANIFEST)
    rows = manifest.read_manifest(spark, str(tmp_path / "m.yaml"))
    got = {r.source_url: tuple(r)[1:] for r in manifest.annotations(rows).collect()}
    assert got == {"https://a.org/x": (datetime.date(2026, 9, 15), "enjoined", "https://c", "true"), "https://b.org/y": (None,) * 4, "https://c.org/z": (None, None, None, "maybe")}
    assert manifest.only(rows, ["https://b.org/y"]).count() == 1 and manifest.only(rows, None).count() == 3
    agents = [("bot a@b.org", True), ("bot (+https://x.org)", False), ("bot a@example.com", False), ("set-a-real-contact-here a@b.org", False), ("", False)]
    df = spark.createDataFrame(agents, "a string, x boolean")
    assert all(r.x == r.y for r in df.withColumn("y", manifest.contactable(F.col("a"))).collect())


def test_snapshots(spark, tmp_path):
    files = {"1.md": "---\nsource_url: https://a.org/x\nnote: 'a: b'\n---\n\n# A\nbody\n", "2.md": "---\nsource_url: https://a.org/x\n---\nlater", "3.md": "no block", "4.md": "---\n: [\n---\nbad"}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    rows = snapshots.read_snapshots(spark, str(tmp_path))
    got = {r.path[-4:]: (r.source_url, r.body) for r in rows.collect()}
    assert got == {"1.md": ("https://a.org/x", "\n# A\nbody\n".lstrip("\n")), "2.md": ("https://a.org/x", "later"), "3.md": (None, "no block"), "4.md": (None, "bad")}
    assert [r.path[-4:] for r in snapshots.index(rows).collect()] == ["2.md"]
    fields = {"title": "Old", "note": 'say "x": y', "resolved_url": "r"}
    df = spark.createDataFrame([(fields, {"title": "New", "source_url": "https://www.a.org/p/Q r/", "resolved_url": None}, "\n\n# A\n")], "e map<string,string>, c map<string,string>, body string")
    out = df.select(F.lit("t").alias("topic"), F.lit("https://www.a.org/p/Q-r/").alias("source_url"), snapshots.merge_fields(F.col("e"), F.col("c")).alias("fields"), "body")
    assert out.first().fields == {"source_url": "https://www.a.org/p/Q r/", "title": "New", "note": 'say "x": y'}
    snapshots.write_snapshots(out, str(tmp_path / "out"))
    back = snapshots.read_snapshots(spark, str(tmp_path / "out")).first()
    assert "name=t-a-q-r.md" in back.path and back.fields == out.first().fields and back.body.rstrip("\0\n") == "# A"


def test_golden(spark, tmp_path):
    row = {"question": "q", "ground_truth_answer": "a", "source_urls": ["u"], "is_advice": False, "verified_on": "2026-01-01", "volatility": "stable", "multi_part": False}
    write = lambda name, rows: (tmp_path / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in rows)) and str(tmp_path / name)
    good = write("g.jsonl", [row, "", row | {"source_urls": ["v", "w"]}])
    assert golden.read_golden(spark, good, 2).count() == 2
    assert sorted((r["row"], r.source_urls) for r in golden.golden_urls(spark, good).collect()) == [(0, ["u"]), (1, ["v", "w"])]
    with pytest.raises(ValueError):
        golden.read_golden(spark, good, 21)
    with pytest.raises(ValueError):
        golden.read_golden(spark, write("h.jsonl", [{k: v for k, v in row.items() if k != "volatility"}]), 1)
    for name, rows in {"i": ["{bad"], "j": [row | {"source_urls": "u"}], "k": [{"x": 1}]}.items():
        assert golden.golden_urls(spark, write(name, rows)) is None
    assert golden.golden_urls(spark, str(tmp_path / "none")) is None
    (tmp_path / "b.json").write_text(json.dumps({"metrics": {"a": 0.5, "b": None}}, indent=1))
    assert {(r.metric, r.value) for r in golden.read_baselines(spark, str(tmp_path / "b.json")).collect()} == {("a", 0.5), ("b", None)}
    golden.write_results(spark.range(2), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2


def test_robots_and_clients(spark):
    pages = spark.createDataFrame([("https://a.org/x/1",), ("https://a.org/y",), ("https://b.org/x/1",), ("https://c.org/x",), (None,)], "url string")
    robots = spark.createDataFrame([("https://a.org", 200, "User-agent: *\nDisallow: /x"), ("https://b.org", 404, "User-agent: *\nDisallow: /")], "host string, status_code int, text string")
    got = {r.url: r.allowed for r in crawl.robots_gate(pages, robots, "bot").collect()}
    assert got == {"https://a.org/x/1": False, "https://a.org/y": True, "https://b.org/x/1": True, "https://c.org/x": True, None: True}


def test_annotations_move_together(spark):
    kinds = "rule_effective_date date, rule_status string, rule_status_source string, rule_status_source_evidences_status boolean"
    wanted = spark.createDataFrame([("a", None, "in_force", None, None), ("b", None, None, None, None), ("x", None, None, None, None)], f"source_url string, {kinds}")
    chunks = spark.createDataFrame([(1, "a", None, "in_force", None, None), (2, "b", None, "enjoined", "u", True), (3, "b", None, None, None, None), (4, "c", None, "scheduled", None, None)], f"id int, source_url string, {kinds}")
    out, told = refresh.sync_annotations(wanted, chunks)
    assert {(r.id, r.rule_status, r.rule_status_source) for r in out.collect()} == {(1, "in_force", None), (2, None, None), (3, None, None), (4, "scheduled", None)}
    assert {tuple(r) for r in told.collect()} == {("a", False, 0, False, False), ("b", True, 2, False, True), ("x", False, 0, True, False)}


def test_tables_change_together(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    assert tables.current(spark, root) is None
    with pytest.raises(FileNotFoundError):
        tables.read_tables(spark, root, ["a"])
    tables.write_tables(spark, root, {"a": spark.range(2), "b": spark.range(3)})
    old = tables.read_tables(spark, root, ["a", "b"])
    tables.write_tables(spark, root, {"a": old["a"].unionByName(spark.range(5)), "b": old["b"]})
    assert {n: df.count() for n, df in tables.read_tables(spark, root, ["a", "b"]).items()} == {"a": 7, "b": 3} and old["a"].count() == 2
    with pytest.raises(Exception):
        tables.write_tables(spark, root, {"a": spark.range(1), "b": spark.range(1).select((1 / (F.col("id") - F.col("id"))).alias("x"), F.raise_error(F.lit("no")).alias("y"))})
    assert tables.read_tables(spark, root, ["a"])["a"].count() == 7


def test_bodies_move_only_for_their_readers(spark):
    bodies = spark.createDataFrame([("u1", "# A"), ("u2", None), ("u3", "")], "source_url string, body string")
    sources = spark.createDataFrame([("u1", "old", None, None, 4), ("u2", "kept", None, None, 1)], "source_url string, last_indexed_body string, fetched_at date, last_changed_at date, change_count int")
    chunks = spark.createDataFrame([], "id long, source_url string, section_heading string, heading_level int, content string, embedding array<double>, " + ", ".join(f"{c} string" for c in ingest.ANNOTATIONS))
    notes = spark.createDataFrame([], "source_url string, " + ", ".join(f"{c} string" for c in ingest.ANNOTATIONS))
    out, _ = ingest.reindex(sources, chunks, bodies, notes, prose.embedder(4), F.lit("2026-09-14").cast("date"))
    assert {(r.source_url, r.last_indexed_body, r.change_count, r.fetched_at is None) for r in out.collect()} == {("u1", "# A", 5, False), ("u2", "kept", 1, True), ("u3", "", 0, False)}
    assert "__body" not in out.drop("last_indexed_body")._jdf.queryExecution().optimizedPlan().toString()


def test_pages_become_chunks(spark):
    pages = spark.createDataFrame([("u1", "<title>P</title><main><h1>P</h1><p>intro</p><h2>A</h2><p>text</p></main> Updated 3/4/2025"), ("u2", "<p>only</p>"), ("u3", None)], "url string, html string")
    bodies = ingest.bodies_of(pages)
    assert {(r.source_url, r.title, r.page_last_updated) for r in bodies.collect()} == {("u1", "P", datetime.date(2025, 3, 4)), ("u2", "u2", None), ("u3", "u3", None)}
    kinds = "rule_effective_date date, rule_status string, rule_status_source string, rule_status_source_evidences_status boolean"
    chunks = spark.createDataFrame([(1, "u1", "h", 1, "old", [1.0], None, None, None, None), (2, "u9", "h", 1, "old", [1.0], None, None, None, None)], f"id long, source_url string, section_heading string, heading_level int, content string, embedding array<double>, {kinds}")
    sources = spark.createDataFrame([("u1", "old", None, None, 4), ("u9", "old", None, None, 0)], "source_url string, last_indexed_body string, fetched_at date, last_changed_at date, change_count int")
    notes = spark.createDataFrame([("u1", None, "in_force", None, None)], f"source_url string, {kinds}")
    now = F.lit("2026-09-14").cast("date")
    new_sources, new_chunks = ingest.reindex(sources, chunks, bodies.where("body is not null"), notes, prose.embedder(4), now)
    assert {(r.source_url, r.content, r.rule_status, len(r.embedding)) for r in new_chunks.collect()} == {("u1", "P\n\nintro", "in_force", 4), ("u1", "P > A\n\ntext", "in_force", 4), ("u2", "Untitled\n\nonly", None, 4), ("u9", "old", None, 1)}
    assert {(r.source_url, r.change_count, r.fetched_at is None) for r in new_sources.collect()} == {("u1", 5, False), ("u2", 0, False), ("u9", 0, True)}
    assert ingest.orphans(new_chunks, new_sources).count() == 0 and ingest.orphans(new_chunks, sources).count() == 1
