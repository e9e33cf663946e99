"""Responses as one plan, and differences of lines, against plain Python."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as tx
from siltstone.operators import evals, ingest, ledger, pipeline
from siltstone.plans import flows
from siltstone.sources import crawl, scratch, snapshots

QUESTIONS = [
    (1, "How many days of grace after the program end date?"),
    (2, "OPT"),  # vague
    (3, "延长 需要 多少 时间 呢 请 告诉 我"),  # another script
    (4, "  how many days of GRACE after the program end date?"),  # as 1
    (5, "Should I file the extension form early this year?"),  # advice
    (6, "nothing matches these unusual words whatsoever"),
    (7, "Which secret travel signature lasts twelve months exactly?"),
    (8, "What about weak passages that barely match anything?"),
    (9, "Was this cached question answered some time ago?"),
    (10, None),
    (11, "Does the last question over budget reach the generator?"),
]


def retrieve_for(spark):
    def retrieve(asked):
        ids = {r.query_id for r in asked.collect()}
        retrieve.seen |= ids
        rows = [(q, p, f"passage {p} of question {q}" + (" keep this hidden" if q == 7 else ""), 0.4 if q == 8 else 2.0 - p / 10) for q in sorted(ids) if q != 6 for p in (1, 2)]
        return spark.createDataFrame(rows, "query_id long, position int, content string, score double")

    retrieve.seen = set()
    return retrieve


def generate(asked):
    generate.seen |= {r.query_id for r in asked.collect()}
    return pipeline.stub(asked)


def test_gated_questions_never_reach_the_generator(spark):
    asked = spark.createDataFrame(QUESTIONS, "query_id long, question string")
    cache = spark.createDataFrame([("was this cached question answered some time ago?", "answer", "from the cache")], "key string, response_type string, answer string")
    retrieve, stages = retrieve_for(spark), pipeline.Stages()
    generate.seen = set()
    out = pipeline.respond(asked, retrieve, generate, cache, cap=3, secrets=["Keep this  hidden"], stages=stages)
    got = {r.query_id: (r.response_type, r.refusal_reason) for r in out.collect()}
    assert got == {
        1: ("answer", None),
        2: ("clarify", "query_too_vague"),
        3: ("no_answer", "non_latin_script_unsupported"),
        4: ("answer", None),
        5: ("refusal_advice", "query_asks_for_personal_advice"),
        6: ("no_answer", "no_chunks_retrieved"),
        7: ("blocked_unverified", "answer_reproduces_system_prompt"),
        8: ("no_answer", "min_distance_exceeds_threshold"),
        9: ("answer", None),
        10: ("clarify", "query_too_vague"),
        11: ("no_answer", "daily_generation_cap_reached"),
    }
    assert retrieve.seen == {1, 5, 6, 7, 8, 11} and generate.seen == {1, 5, 7}
    assert stages.counts() == {"retrieval": 6, "generation": 3, "checks": 3}
    answers = {r.query_id: r.answer for r in out.collect()}
    assert answers[9] == "from the cache" and answers[1] == answers[4] and answers[7] is None
    kept = {r.key: r.response_type for r in pipeline.cacheable(out, asked).collect()}
    assert len(kept) == 3 and set(kept.values()) == {"answer", "refusal_advice"}


def test_passages_move_as_ids(spark, tmp_path, monkeypatch):
    """Whole texts lead for many questions; no stage gets them, and the stub looks up how the first begins."""
    rows = [(1, "s", "visa  extension\nform " + "visa " * 50_000), (2, "s", "visa extension\nonce"), (3, "s", "permit fee\nlist " + "permit " * 50_000), (3, "s", "permit again"), (4, "s", None)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    asked = [(c, 0, "user", q) for c, q in enumerate(["Which visa extension form is due next year?", "Which permit fee list is due next year?"] * 20 + ["Nothing here is about unusual matters whatsoever"])]
    spark.createDataFrame(asked, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    held, write = {}, scratch.written

    def written(df, name):
        held[name] = write(df, name)
        return held[name]

    monkeypatch.setattr(pipeline.scratch, "written", written)
    got = {r.query_id // 1000: r for r in flows.answer_pipeline(spark, str(tmp_path)).collect()}
    for stage in ("retrieved", "generation"):
        assert held[stage].schema["passages"].dataType.simpleString() == "array<struct<id:bigint,score:double>>"
        assert held[stage].count() > 0
    said = "Stub answer. The retrieved context addresses this question [1, 2]. "
    begins = ["visa  extension\nform " + "visa " * 50_000, "permit again"]  # the least text of a repeated id
    want = [hashlib.md5((said + " ".join(t[:100].split()) + (" " if t[99:100] == " " else "")).encode()).hexdigest() for t in begins]
    assert [got[c].answer for c in range(40)] == want * 20
    assert (got[40].response_type, got[40].refusal_reason, got[40].answer) == ("no_answer", "no_chunks_retrieved", None)


def test_stub_by_ids_says_what_it_says_of_texts(spark):
    texts = [(1, "first  text"), (2, "second " * 40), (3, None)]
    asked = [(q, [(i, 2.0 - i) for i in ids]) for q, ids in enumerate([[1], [2, 1], [2], [3], [9]])]
    by_id = spark.createDataFrame(asked, "query_id long, passages array<struct<id: long, score: double>>")
    own = dict(texts)
    whole = spark.createDataFrame([(q, [(own.get(i), s) for i, s in p]) for q, p in asked], "query_id long, passages array<struct<content: string, score: double>>")
    got = pipeline.stub(by_id, spark.createDataFrame(texts, "id long, content string")).collect()
    assert len(got) == len(asked) and {tuple(r) for r in got} == {tuple(r) for r in pipeline.stub(whole).collect()}


def test_responses_to_nothing(spark):
    asked = spark.createDataFrame([], "query_id long, question string")
    assert pipeline.respond(asked, retrieve_for(spark), cap=1).count() == 0


def test_differences_of_lines(spark):
    r = random.Random(3)
    rows = [(i, [r.choice("abcd") for _ in range(r.randrange(8))], [r.choice("abcd") for _ in range(r.randrange(8))]) for i in range(200)] + [(200, None, ["a"]), (201, ["a", "a"], None), (202, [], [])]
    got = {}
    for x in ledger.line_changes(spark.createDataFrame(rows, "k int, o array<string>, n array<string>"), "k", "o", "n").collect():
        got[x.k, x.line] = (x.change, x.n, x["at"])
    want = {}
    for k, o, n in rows:
        a, b = Counter(o or []), Counter(n or [])
        for line in a.keys() | b.keys():
            d = b[line] - a[line]
            if d:
                want[k, line] = ("added" if d > 0 else "removed", abs(d), (n if d > 0 else o).index(line))
    assert got == want


def test_highlights_keep_their_order(spark):
    lines = ["60 days and Form I-20", "60 DAYS, 30 days", "form i-20 must not"]
    got = spark.createDataFrame([(lines,)], "x array<string>").select(tx.highlights(F.col("x")).alias("h")).first().h
    assert [h.lower() for h in got] == list(dict.fromkeys(h.lower() for h in got)) and got[0].startswith("60")


@pytest.mark.parametrize("layers", [0, 1, 7, 40])
def test_headings_of_many_wrappers(spark, layers):
    text = "Plain *heading* [x]"
    for i in range(layers):
        text = [f"**{text}**", f"__ {text} __", f"[{text}](#a{i})"][i % 3]
    row = spark.createDataFrame([(text,)], "h string").select(tx.clean_heading(F.col("h")).alias("x")).first()
    assert row.x == "Plain *heading* [x]"


def test_quantiles_with_infinite_values(spark):
    inf = float("inf")
    df = spark.range(30_000).select(F.when(F.col("id") == 7, inf).when(F.col("id").isin(8, 9), -inf).when(F.col("id") == 10, float("nan")).otherwise(F.col("id").cast("double")).alias("v"))
    got = evals.quantiles(df, "v", [0.0, 0.5, 1.0])
    finite = sorted(float(i) for i in range(30_000) if i not in (7, 8, 9, 10))
    values = [-inf, -inf, *finite, inf]
    k = (len(values) - 1) * 0.5
    assert got == [-inf, values[int(k)] + (values[int(k) + 1] - values[int(k)]) * (k % 1), inf]
    huge = spark.createDataFrame([(1.5e308,), (-1.5e308,)] * 6000 + [(0.0,)], "v double")
    assert evals.quantiles(huge, "v", [0.5]) == [0.0]
    assert evals.quantiles(spark.createDataFrame([(inf,), (-inf,)], "v double"), "v", [0.0, 0.5, 1.0]) == [-inf, -inf, inf]


def test_rows_that_fail_no_job(spark, tmp_path):
    deep = "<div>" * 5000 + "text" + "</div>" * 5000
    pages = spark.createDataFrame([("u1", deep), ("u2", "<p>fine</p>"), ("u3", None)], "url string, html string")
    got = {r.source_url: (r.body, r.error) for r in ingest.bodies_of(pages).collect()}
    assert got == {"u1": ("text\n", None), "u2": ("fine\n", None), "u3": (None, None)}
    (tmp_path / "1.md").write_text("---\nfetched_at: 2026-13-45\nsource_url: u\n---\nbody")
    (tmp_path / "2.md").write_text("---\nsource_url: v\n---\nbody")
    rows = {r.path[-4:]: (r.source_url, r.fields, r.body) for r in snapshots.read_snapshots(spark, str(tmp_path)).collect()}
    assert rows["1.md"] == (None, None, "body") and rows["2.md"][0] == "v"
    asked = spark.createDataFrame([("http://[::1/a",), ("http://h.org/a",)], "url string")
    robots = spark.createDataFrame([("http://[::1", 200, "User-agent: *\nDisallow: /x"), ("http://h.org", 200, "User-agent: *\nDisallow: /x")], "host string, status_code int, text string")
    assert {r.url: r.allowed for r in crawl.robots_gate(asked, robots, "bot").collect()} == {"http://[::1/a": False, "http://h.org/a": True}


def test_json_bodies(spark):
    bodies = ['{"question": "call 078-05-1120", "n": 1.5, "x": [1, {"b": null}]}', '{"question": 5}', "[1]", "no json 078-05-1120", '{"question": "a", "question": "078-05-1120"}', "", None, '{"a": {"question": "078-05-1120"}}']
    got = [r.x for r in spark.createDataFrame(list(enumerate(bodies)), "i int, b string").select("i", tx.redact_question(F.col("b")).alias("x")).orderBy("i").collect()]
    assert got[0] == '{"n":1.5,"question":"call [redacted-ssn]","x":[1,{"b":null}]}'
    assert got[4] == '{"question": "[redacted-ssn]"}'
    assert [g for i, g in enumerate(got) if i not in (0, 4)] == [b for i, b in enumerate(bodies) if i not in (0, 4)]
