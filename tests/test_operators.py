"""Operators on small tables: nulls, ties, empty inputs, and the rules that the test tables don't reach."""

import datetime
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from siltstone.functions import html as ht
from siltstone.functions import prose, rules, stems
from siltstone.functions import text as tx
from siltstone.functions.isolate import isolated
from siltstone.operators import answers, buckets, evals, ledger, refresh, search
from siltstone.streaming.buckets import stream_token_bucket


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("text,expect", [("see [1]", [1]), ("[1, 3] and [3]", [1, 3]), ("none", []), ("[x] [ 2 ]", []), (None, None)])
def test_cited(spark, text, expect):
    assert one(spark, text, tx.cited) == expect


@pytest.mark.parametrize(
    "text,expect",
    [
        ("mail a.b@c.org", "mail [redacted-email]"),
        ("A12345678", "[redacted-a-number]"),
        ("078-05-1120", "[redacted-ssn]"),
        ("(212) 555-0123", "[redacted-phone]"),
        ("a@b.co A-1234567 078-05-1120", "[redacted-email] [redacted-a-number] [redacted-ssn]"),
        ("nothing", "nothing"),
    ],
)
def test_redact(spark, text, expect):
    assert one(spark, text, tx.redact) == expect
    assert one(spark, expect, tx.redact) == expect


def test_session_hash(spark):
    for secret in ("s", "long" * 40):
        assert one(spark, "peer", lambda c: tx.session_hash(c, secret)) == tx.session_hash_of("peer", secret)


@pytest.mark.parametrize(
    "text,expect",
    [
        ("60 days [2], 1,000 of I-20 in 2026", ["1000", "60"]),
        ("01/30/2026 and 1/2", ["1", "2"]),
        ("1/5/26 or 01/30/2026, not 30", ["30"]),
        ("May 5, 2026 at http://a.b/9", []),
        ("on Sept. 15, 2026 and Nov 14 2030 for 15 days", ["15"]),
        ("[ 1 , 3 ] H-1B I-765, 65,000 per i94.x", ["65000", "94"]),
        ("1899 1900 2100 2101", ["1899", "2101"]),
        ("", []),
    ],
)
def test_figures(spark, text, expect):
    assert one(spark, text, tx.figures) == expect


def test_sentences(spark):
    text = "It ends.  From Sept. 15, 2026 on!\nIn Dec. it ends? x"
    parts = one(spark, text, tx.sentence_parts)
    assert "".join(p.sentence + p.separator for p in parts) == text
    assert [p.sentence for p in parts] == ["It ends.", "From Sept. 15, 2026 on!", "In Dec.", "it ends?", "x"]


@pytest.mark.parametrize("text,expect", [("on Sept. 05, 2026", True), ("September 5 2026", True), ("Sep 5, 2026", True), ("Sept. 15, 2026", False), ("Sept. 5, 2027", False), ("May 5, 2026", False)])
def test_stated_dates(spark, text, expect):
    df = spark.createDataFrame([(text, datetime.date(2026, 9, 5))], "t string, d date")
    assert df.select(F.regexp_like("t", tx.date_pattern(F.col("d")))).first()[0] == expect


def test_snippet_and_lead(spark):
    assert one(spark, "word " * 100, tx.snippet).endswith("word...") and one(spark, "a  b", tx.snippet) == "a b"
    assert one(spark, "Yes. More follows.", tx.lead) == "Yes." and one(spark, "Only this.", tx.lead) is None
    assert one(spark, "Only this.\n\nMore", tx.lead) == "Only this." and one(spark, "3.5 is it. Yes", tx.lead) == "3.5 is it." and one(spark, "x" * 91 + ". y", tx.lead) is None


@pytest.mark.parametrize(
    "question,vague,other",
    [
        ("How long is the STEM OPT extension?", False, False),
        ("OPT?", True, False),
        ("OPT extension", False, False),
        ("what about it", True, False),
        ("签证", True, True),
        ("STEM OPT 延期可以延长多少个月？", False, False),
        ("옵티 연장은 몇 개월인가요?", False, True),
        ("Cuánto dura la extensión", False, False),
        ("नियम क्या है", False, True),
        ("— 😀", True, False),
        ("", True, False),
    ],
)
def test_vague_and_other_scripts(spark, question, vague, other):
    assert (one(spark, question, tx.too_vague), one(spark, question, tx.other_script)) == (vague, other)


@pytest.mark.parametrize(
    "text,expect",
    [
        ("This answer is authoritative.", "authoritative"),
        ("This is not legal advice.", None),
        ("This tool is official.", "official_self_claim"),
        ("This tool is not official.", None),
        ("As a STEM OPT student, your designated school official decides.", None),
        ("As a USCIS officer, I can say.", "agency_role"),
        ("Speaking as your immigration counsel, go.", "attorney_persona"),
        ("Ask a licensed immigration attorney. I am here.", None),
        ("This reflects official USCIS guidance. This guidance is official USCIS guidance.", "official_guidance"),
        ("This is an unofficial tool affiliated with nobody.", None),
        ("This is officially the last day.", None),
        ("See the page. We are USCIS officers' friends on behalf of DHS.", "on_behalf_of"),
        ("", None),
        (None, None),
    ],
)
def test_authority_claims(spark, text, expect):
    assert one(spark, text, tx.authority_claim) == expect


def test_leaks(spark):
    scan = lambda c: tx.leak_class(c, ["Answer only from the passages"], ["takes effect on"], [r"(?im)^\s*Context passages:\s*$"], ["0a1b2c"])
    cases = [("**Answer** only\nfrom the PASSAGES", "rule_text"), ("It takes  effect on", "context_format"), ("a\ncontext passages:\nb", "context_format"), ("the context passages: b", None), ("0A1B2C", "version_hash"), ("Ａnswer only from the passages", "rule_text"), ("clean", None)]
    for text, expect in cases:
        assert one(spark, text, scan) == expect


def test_headings_and_quotes(spark):
    for text, expect in [("**A**", "A"), ("[**A b**](#x)", "A b"), ("__[A](b)__", "A"), ("A **b**", "A **b**"), ("[A](b) c", "[A](b) c"), ("  ", "")]:
        assert one(spark, text, tx.clean_heading) == expect
    df = spark.createDataFrame([("T", "P", "H"), ("T", None, "T"), ("T", "", "H")], "a string, b string, c string")
    assert [r.x for r in df.select(tx.breadcrumb(F.col("a"), F.col("b"), F.col("c")).alias("x")).collect()] == ["T > P > H", "T", "T > H"]
    body = "Page > H\n\n![x](y) " + "word " * 60
    assert one(spark, body, tx.quote_of_chunk).endswith("word...") and one(spark, "no body", tx.quote_of_chunk) == "" and one(spark, "a\n\nshort", tx.quote_of_chunk) == ""
    df = spark.createDataFrame([("Page > Head " + "x" * 40, "Head"), ("the Head " + "x" * 40, "Head"), ("Head short", "Head"), ("a ", None)], "s string, h string")
    assert [r.x for r in df.select(tx.quote_of_snippet(F.col("s"), F.col("h")).alias("x")).collect()] == ["x" * 40, "the Head " + "x" * 40, "Head short", "a"]


def test_headings_of_any_length_and_marks(spark):
    """Layers are peeled as one by one, and a long heading costs no look for each of its characters."""
    import random
    import re
    import time

    wrapped = r"^(?:\*\*.+\*\*|__.+__|\[.+\]\([^)]*\))$"

    def bare(text):
        text = text.strip(" ")
        while re.search(wrapped, text):
            text = re.sub(r"^\[(.+)\]\([^)]*\)$", r"\1", re.sub(r"^\*\*(.+)\*\*$|^__(.+)__$", lambda m: m[1] or m[2], text)).strip(" ")
        return text

    dice = random.Random(5)
    texts = ["".join(dice.choices(["**", "__", "*", "_", "[", "](", "](u)", ")", " ", "a"], k=dice.randrange(14))) for _ in range(3000)]
    for i in range(3000):
        text = dice.choice(["a", "a [b](c)", "*", " "])
        for _ in range(dice.randrange(6)):
            text = dice.choice(["**{}**", "__ {}__", "[{} ](u)", "[{}](a](b)", "{} "]).format(text)
        texts.append(text)
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, h string").select("k", tx.clean_heading(F.col("h")).alias("x")).collect()
    assert [(texts[r.k], r.x) for r in rows if r.x != bare(texts[r.k])] == []
    began = time.monotonic()
    long = spark.range(1).select(F.concat(F.lit("**"), F.repeat(F.lit("word "), 400_000), F.lit("z**")).alias("h"))
    assert long.select(F.length(tx.clean_heading(F.col("h")))).first()[0] == 2_000_001 and time.monotonic() - began < 30


def moved(df, capsys):
    """Columns of all shuffles of a plan."""
    import re

    capsys.readouterr()
    df.explain("formatted")
    found = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", capsys.readouterr().out)
    assert found
    return {c.split("#")[0].strip() for x in found for c in x.split(",")}


def test_cards_without_moving_content(spark, capsys):
    from siltstone.plans import answers as plans

    body = "Page > H\n\n" + "prose " * 60
    cited = spark.createDataFrame([(1, 1, 7, "https://www.a.org/p", "Page > H " + "s" * 40), (1, 2, 8, "https://b.org", "Page > H " + "s" * 40), (1, 3, 9, "https://b.org", None)], "query_id int, position int, chunk_id int, url string, snippet string")
    held = spark.createDataFrame([(1, 7, 2, "later", "x"), (1, 7, 1, "H", body), (1, 8, 1, "H", "short"), (1, 9, 1, None, None)], "query_id int, chunk_id int, ordinal int, heading string, content string")
    days = spark.createDataFrame([(1, "https://b.org", 1, datetime.date(2026, 1, 5), datetime.date(2026, 9, 14))], "query_id int, url string, ordinal int, page_last_updated date, last_verified_at date")
    today = F.lit("2026-09-14").cast("date")
    cards = answers.source_cards(cited, held, days, today)
    quoted = answers.source_cards(cited, held.withColumn("quote", tx.quote_of_chunk(F.col("content"))).drop("content"), days, today)
    expect = [(1, "H", ("prose " * 40).strip() + "...", "a.org", None, None), (2, "H", "s" * 40, "b.org", "Jan 5, 2026", "today"), (3, "b.org", None, "b.org", "Jan 5, 2026", "today")]
    for df in (cards, quoted):
        assert [(r["index"], r.title, r.quote, r.domain, r.updated, r.verified) for r in df.orderBy("index").collect()] == expect
    assert "content" not in moved(cards, capsys)
    columns = moved(plans.source_cards(spark, "/root/testdata/sf0.001"), capsys)
    assert not columns & {"content", "text"} and {"snippet", "quote"} <= columns


def test_json_redaction(spark):
    import json

    got = one(spark, '{"question": "mail a@b.co", "n": [1, {"x": "a@b.co"}], "z": null}', tx.redact_question)
    assert json.loads(got) == {"question": "mail [redacted-email]", "n": [1, {"x": "a@b.co"}], "z": None}
    for same in ("not json", "[1]", '{"question": 5}', '{"q": "a@b.co"}', None):
        assert one(spark, same, tx.redact_question) == same


def test_advice_verdicts(spark):
    for text, expect in [('x {"advice": true} y', True), ('{"advice": false}', False), ('{"advice": "true"}', None), ("none", None), ("{bad", None), ('{"advice": {"a": true}}', None), (None, None)]:
        assert one(spark, text, tx.advice_verdict) == expect


def test_model_families(spark):
    assert one(spark, "openai/gpt-oss:120b", tx.model_family) == "gpt-oss" and one(spark, "GLM-qwen", tx.model_family) == "qwen"
    for text in ("unknown", "", None):
        with pytest.raises(Exception, match="no known family"):
            one(spark, text, tx.model_family)


def test_markdown_of_pages():
    page = """<html><head><title>T</title><style>x</style></head><body><nav>menu</nav><div class="region-content">out</div><main><h1>A  b</h1><p>One <b>two</b> <a href="/x">three</a>
      <p>Four<ul><li>a<li>b <ul><li>c</ul></ul><div class="social-share">no</div><dl><dt>Q?</dt><dd>An answer</dd></dl><table><tr><th>h<th>i<tr><td>1<td>2</table><script>no()</script></main></body></html>"""
    got = ht.page_markdown(page)
    assert got == "# A b\n\nOne **two** [three](/x)\n\nFour\n\n- a\n- b\n  - c\n\n## Q?\n\nAn answer\n\n| h | i |\n| --- | --- |\n| 1 | 2 |\n"
    assert ht.page_markdown("<article>x</article><p>y") == "x\n" and ht.page_markdown("") == "\n" and ht.page_markdown('<div role="main">m</div>z') == "m\n"
    assert ht.page_markdown("<body><footer>f</footer><p id='breadcrumbs'>b</p>text &amp; more") == "text & more\n"


def test_page_days(spark):
    cases = [("Last Reviewed/Updated: 01/30/2026", datetime.date(2026, 1, 30)), ("x Last updated: Sept. 5, 2026 y", datetime.date(2026, 9, 5)), ("Updated 3/4/2025", datetime.date(2025, 3, 4)), ("Last updated: Smarch 5, 2026", None), ("Last Reviewed/Updated: 13/45/2026", None), ("none", None)]
    for text, expect in cases:
        assert one(spark, text, ht.last_updated) == expect


def test_inline_and_blocks():
    assert prose.inline("a **b _c_** [1, 2] [l](https://x.y) [m](javascript:z)") == [
        {"kind": "text", "value": "a "}, {"kind": "bold", "children": [{"kind": "text", "value": "b "}, {"kind": "italic", "children": [{"kind": "text", "value": "c"}]}]}, {"kind": "text", "value": " "},
        {"kind": "citation", "indices": [1, 2]}, {"kind": "text", "value": " "}, {"kind": "link", "label": "l", "url": "https://x.y"}, {"kind": "text", "value": " "}, {"kind": "text", "value": "[m](javascript:z)"},
    ]
    assert prose.blocks("# T\n- a\n* b\n1. c\nd\n\n e\n## U\n## V") == [
        {"kind": "heading", "text": "T"}, {"kind": "bullet-list", "items": ["a", "b"]}, {"kind": "numbered-list", "items": ["c"]}, {"kind": "paragraph", "text": "d e"}, {"kind": "heading", "text": "U"}, {"kind": "heading", "text": "V"},
    ]


def test_embedder(spark):
    a, b = (one(spark, "text", prose.embedder(10)) for _ in range(2))
    assert a == b and len(a) == 10 and abs(sum(v * v for v in a) - 1) < 1e-12 and one(spark, "other", prose.embedder(10)) != a
    with pytest.raises(Exception, match="above 3"):
        one(spark, "text", prose.embedder(10, 3))


DAY, TODAY = datetime.date(2026, 9, 15), datetime.date(2026, 9, 14)


@pytest.mark.parametrize(
    "status,day,expect",
    [
        (None, None, None),
        (None, DAY, "took effect on September 15, 2026"),
        ("in_force", None, "is in force today, September 14, 2026."),
        ("scheduled", DAY, "takes effect on September 15, 2026 (after today"),
        ("scheduled", None, "is not in force today"),
        ("enjoined", DAY, "was scheduled to take effect on September 15, 2026 but is blocked"),
        ("enjoined", None, "is blocked by a court order"),
        ("not_in_force", DAY, "dated September 15, 2026 that is not in force"),
        ("not_in_force", None, "a rule that is not in force today"),
    ],
)
def test_notes(spark, status, day, expect):
    got = spark.createDataFrame([(status, day)], "s string, d date").select(rules.note(F.col("s"), F.col("d"), F.lit(TODAY))).first()[0]
    assert got is expect if expect is None else expect in got
    assert expect is None or "[" not in got


def test_note_of_an_unknown_status(spark):
    with pytest.raises(Exception, match="no wording"):
        spark.createDataFrame([("odd", None)], "s string, d date").select(rules.note(F.col("s"), F.col("d"), F.lit(TODAY))).collect()


def test_entries(spark):
    cases = [
        (None, None, None, None, None), ("in_force", TODAY, None, None, None), ("scheduled", DAY, None, None, None), ("enjoined", None, "u", "true", None), (None, None, "u", None, "source_without_evidence"), (None, None, "u", "maybe", "evidence_not_boolean"),
        (None, DAY, None, None, "date_without_status"), ("odd", DAY, None, None, "unknown_status"), ("scheduled", None, None, None, "scheduled_without_date"), ("scheduled", TODAY, None, None, "scheduled_not_in_future"),
        ("in_force", DAY, None, None, "in_force_in_future"), ("enjoined", None, None, None, "status_without_source"), ("not_in_force", DAY, "", "false", "status_without_source"),
    ]
    df = spark.createDataFrame(cases, "s string, d date, u string, e string, x string")
    assert all(r.x == r.y for r in df.withColumn("y", rules.entry_error(F.col("s"), F.col("d"), F.col("u"), F.col("e"), F.lit(TODAY))).collect())


PASSAGES = "query_id long, position int, url string, content string, heading string, rule_effective_date date, rule_status string, rule_status_source string, rule_status_source_evidences_status boolean"


def qualified(spark, answer, *passages):
    rows = [(1, i, f"u{i}", c, "h", d, s, None, None) for i, (c, s, d) in enumerate(passages, 1)]
    out = answers.qualify_figures(spark.createDataFrame([(1, answer)], "query_id long, answer string"), spark.createDataFrame(rows, PASSAGES), F.lit(TODAY))
    r = out.first()
    return r.text, r.insertions, r.blocked, r.blocked_urls


NOW, SOON, STOPPED = ("You have 60 days.", None, None), ("You have 30 days.", "scheduled", DAY), ("You have 30 days.", "enjoined", None)


def test_figures_of_rules_not_in_force(spark):
    said = " That figure comes from a rule that takes effect on September 15, 2026. It is not the rule in force today, September 14, 2026."
    assert qualified(spark, "It was 60 days, it becomes 30.  Next.", NOW, SOON) == ("It was 60 days, it becomes 30." + said + "  Next.", 1, False, [])
    text, n, blocked, urls = qualified(spark, "You have 30 days.", NOW, SOON, STOPPED)
    assert (n, blocked, urls) == (1, True, ["u2", "u3"]) and said in text
    assert qualified(spark, "From Sept. 15, 2026 you have 30 days.", NOW, SOON) == ("From Sept. 15, 2026 you have 30 days.", 0, False, [])
    assert qualified(spark, "From Sept. 16, 2026 you have 30 days.", NOW, SOON)[1] == 1
    assert qualified(spark, "You have 30 days.", ("30 days", "in_force", DAY), SOON) == ("You have 30 days.", 0, False, [])
    assert "blocked by a court order" in qualified(spark, "30 or 60 days.", NOW, STOPPED)[0]
    assert qualified(spark, "", NOW, SOON) == ("", 0, False, []) and "[" not in qualified(spark, "30", SOON)[0]


def test_notice_texts(spark):
    rows = [
        (1, 1, "a", "", "h", DAY, "enjoined", "court", True), (1, 2, "b", "", "h", DAY, "enjoined", "court", True), (1, 3, "c", "", "h", None, "in_force", None, None), (1, 4, "a", "", "h", None, None, None, None),
        (2, 1, "d", "", "h", None, None, None, None), (3, 1, "e", "", "h", None, "not_in_force", "order", False), (3, 2, "f", "", "h", DAY, "scheduled", None, None),
    ]
    found = answers.notices(spark.createDataFrame(rows, PASSAGES), spark.createDataFrame([(1, [3]), (3, [])], "query_id long, cited array<int>"))
    assert {(r.query_id, r.url, r.reason) for r in found.collect()} == {(1, "a", "top_ranked"), (1, "b", "retrieved"), (1, "c", "cited"), (3, "e", "top_ranked"), (3, "f", "retrieved")}
    got = {r.query_id: r.notice for r in answers.notice_texts(found, F.lit(TODAY)).collect()}
    assert got[1] == (
        "Some of the sources above describe a rule that was scheduled to take effect on September 15, 2026. A court has blocked it and it is not in force. See [the court's order](court). "
        "One of the sources above describes a rule that is in force today, September 14, 2026. See [the source](c)."
    )
    assert "the page above does not say it. See [the rule as published](order)." in got[3] and "takes effect on September 15, 2026, so the answer differs" in got[3] and 2 not in got
    many = spark.range(1).select(rules.links(F.array(*map(F.lit, "abcdef")), F.lit("source"))).first()[0]
    assert many.startswith("[the first source](a), ") and many.endswith("[the fifth source](e), and [a source](f)")


def test_refresh_routes(spark):
    tries = [("a", 1, "timeout", None), ("a", 2, "ok", "new"), ("a", 3, "http_error", None), ("b", 1, "robots", None), ("b", 2, "ok", "x"), ("c", 1, "timeout", None), ("c", 2, "http_error", None), ("c", 3, "timeout", None), ("c", 4, "ok", "x"), ("d", 1, "ok", "x"), ("e", 1, "ok", "x"), ("f", 1, "ok", "x")]
    got = refresh.settle_fetches(spark.createDataFrame([(*t, None) for t in tries], "source_url string, attempt int, outcome string, body string, http_status int"))
    assert {(r.source_url, r.attempts, r.outcome) for r in got.collect()} == {("a", 2, "ok"), ("b", 1, "robots"), ("c", 3, "timeout"), ("d", 1, "ok"), ("e", 1, "ok"), ("f", 1, "ok")}
    sources = spark.createDataFrame([("a", "old"), ("d", "x"), ("e", None)], "source_url string, last_indexed_body string")
    verdict = F.when(F.col("body") == F.col("last_indexed_body"), "unchanged").otherwise("meaningful")
    routes = {r.source_url: (r.status, r.reason, r.path) for r in refresh.route_sources(got, sources, spark.createDataFrame([("e",)], "source_url string"), verdict).collect()}
    assert routes == {
        "a": ("meaningful", "compared", "reindex"), "b": ("robots_disallowed", "robots_disallowed", "record_failure"), "c": ("fetch_failed", "timeout", "record_failure"),
        "d": ("unchanged", "compared", "verify_only"), "e": ("fetch_failed", "baseline_missing", "record_failure"), "f": ("meaningful", "no_existing_snapshot", "reindex"),
    }


def test_gates(spark):
    df = spark.createDataFrame([(1.0, ">=", 1.0, True), (None, ">=", 1.0, False), (0.1, "==", 0.0, False), (0.5, "<=", 1.0, True), (0.5, None, None, None)], "v double, op string, b double, x boolean")
    assert all(r.x == r.y for r in df.withColumn("y", evals.verdict(F.col("v"), F.col("op"), F.col("b"))).collect())
    v = spark.createDataFrame([(True, True), (False, False), (True, None)], "gated boolean, passed boolean")
    assert tuple(evals.roll_up(v, F.lit(False)).first()) == (False, 2, 1) and tuple(evals.roll_up(v.limit(2), F.lit(True)).first()) == (False, 1, 0) and evals.roll_up(v.limit(0), F.lit(False)).first().passed
    with pytest.raises(Exception, match="unknown response type"):
        spark.range(1).select(evals.refusal_class(F.lit("odd"))).collect()


@pytest.mark.parametrize("few", [10_000, 1])
def test_quantiles(spark, few, monkeypatch):
    import numpy as np

    monkeypatch.setattr(evals, "FEW", few)
    x = [float(v) for v in np.random.default_rng(0).exponential(5, 300)] + [7.0] * 50 + [1e9]
    df = spark.createDataFrame([(v,) for v in [*x, None, float("nan")]], "v double")
    assert np.allclose(evals.quantiles(df, "v", [0, 0.5, 0.95, 1]), np.quantile(x, [0, 0.5, 0.95, 1])) and evals.quantiles(df.limit(0), "v", [0.5]) == [None]


def test_nearest(spark, monkeypatch):
    rows = [(i, [float(i), 1.0]) for i in range(30)] + [(90, None), (91, [0.0, 0.0]), (92, [1.0])]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [3.0, 1.0]), (2, [3.0, 1.0]), (3, None), (4, [0.0, 1.0])], "query_id long, embedding array<double>")
    for limit in (1 << 30, -1):
        monkeypatch.setattr(search, "BROADCAST", limit)
        monkeypatch.setattr(search, "ROWS", 7)
        got = {(r.query_id, r["rank"]): r.id for r in search.nearest(vectors, asked, k=3).collect()}
        assert got == {(1, 1): 3, (1, 2): 4, (1, 3): 5, (2, 1): 3, (2, 2): 4, (2, 3): 5, (4, 1): 0, (4, 2): 1, (4, 3): 2}
    grouped = search.nearest(vectors.withColumn("g", F.col("id") % 2), asked.withColumn("g", F.when(F.col("query_id") == 1, 0)), 2, "g")
    assert {(r.query_id, r.id, r.g) for r in grouped.collect()} == {(1, 2, "0"), (1, 4, "0")}
    assert search.nearest(vectors.limit(0), asked).count() == 0 and search.nearest(vectors, asked.limit(0)).count() == 0


def test_keyword_rank(spark):
    docs = spark.createDataFrame([(1, "Grace period", "sixty days grace grace"), (2, "Other", "grace"), (3, None, None)], "id long, heading string, content string")
    asked = spark.createDataFrame([(1, "the grace days"), (2, "of an the"), (3, None)], "query_id long, text string")
    got = [(r.query_id, r.id, r.score, r["rank"]) for r in search.keyword_rank(docs, asked).orderBy("rank").collect()]
    assert got == [(1, 1, 2.2, 1), (1, 2, 0.4, 2)]


def test_failures_and_health(spark):
    rows = [(1, i, e) for i, e in enumerate("ffrfsff")]
    df = spark.createDataFrame(rows, "s int, t int, e string")
    out = ledger.failure_counts(df, "s", ["t"], F.col("e") == "f", F.col("e") == "r").orderBy("t")
    assert [r.consecutive_failures for r in out.collect()] == [1, 2, 2, 3, 0, 1, 2]
    cases = [(0, "none", 1.0, "ok"), (3, "none", 1.0, "broken"), (0, "robots_disallowed", 1.0, "broken"), (0, "none", None, "broken"), (0, "none", 168.0, "ok"), (0, "none", 168.1, "broken")]
    df = spark.createDataFrame(cases, "n int, e string, h double, x string")
    assert all(r.x == r.y for r in df.withColumn("y", ledger.health(F.col("n"), F.col("e"), F.col("h"))).collect())
    bands = spark.createDataFrame([(None, "unknown"), (0.0, "current"), (24.0, "current"), (24.1, "recent"), (168.0, "recent"), (168.1, "stale"), (-1.0, "current")], "h double, x string")
    assert all(r.x == r.y for r in bands.withColumn("y", ledger.freshness(F.col("h"))).collect())


def test_classify(spark):
    cases = [("a\nb", "a\nb", "unchanged"), ("a\nb", "b\na", "cosmetic"), ("a\nb", "A!\nb", "cosmetic"), ("a", "a\n[more](x)", "unchanged"), ("60 days", "30 days", "meaningful"), ("a", "a\nLast updated: 2026", "unchanged"), ("“a” – b", "\"a\" - b", "unchanged"), ("", "", "unchanged")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "k int, a string, b string, x string")
    pairs = df.select("k", "x", tx.content_lines(F.col("a")).alias("old"), tx.content_lines(F.col("b")).alias("new"))
    got = {r.k: r.status for r in ledger.classify(pairs, "k", "old", "new").collect()}
    assert got == {i: c[2] for i, c in enumerate(cases)}


def test_evidence_of_changes(spark):
    old, new = "a\nb\nb\nsame", "same\nc must\nc must\nBy Sept. 5, 2026 for $1,200 MUST\n" + "\n".join(f"x{i}" for i in range(30))
    pairs = spark.createDataFrame([(1, old, new)], "k int, a string, b string").select("k", tx.content_lines(F.col("a")).alias("old"), tx.content_lines(F.col("b")).alias("new"))
    r = ledger.classify(pairs, "k", "old", "new").first()
    assert (r.status, r.removed, r.removed_count, r.added_count, len(r.added)) == ("meaningful", ["a", "b", "b"], 3, 33, 20)
    assert r.added[:3] == ["c must", "c must", "By Sept. 5, 2026 for $1,200 MUST"] and r.highlights == ["must", "Sept. 5, 2026", "$1,200"]


def test_sections(spark):
    body = "above\n# **Title**\nintro\n## Group\n### [One](#one)\ntext\n```\n## not a heading\n```\n# later\n## Two\nmore\n#\n### ** **\n#### Deep\nend"
    sections = lambda t: [(r.level, r.heading, r.parent, r.breadcrumb, r.chunk) for r in ledger.sections(spark.createDataFrame([(1, t)], "k int, body string"), "k", "body").orderBy("line").collect()]
    got = sections(body)
    assert got[0] == (1, "Title", None, "Title", "intro")
    assert got[1][:4] == (3, "One", "Group", "Title > Group > One") and "## not a heading" in got[1][4] and got[1][4].endswith("# later")
    assert got[2][:3] == (2, "Two", "Group") and got[3] == (4, "Deep", "Group", "Title > Group > Deep", "end")
    assert sections("no headings\nat all") == [(1, "Untitled", None, "Untitled", "no headings\nat all")] and sections("") == []
    assert sections("#### Only\ntext") == [(1, "Only", None, "Only", "text")]


def test_upserts(spark):
    old, new = (spark.createDataFrame(r, "k string, n long") for r in ([("a", 1), ("b", 2)], [("b", 5), ("c", 6)]))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(ledger.upsert(old, new, "k")) == [("a", 1), ("b", 5), ("c", 6)]
    assert rows(ledger.insert_absent(old, new, "k")) == [("a", 1), ("b", 2), ("c", 6)]
    assert rows(ledger.increment(old, new, "k", "n")) == [("a", 1), ("b", 7), ("c", 6)]
    assert rows(ledger.replace_group(old, new.limit(0), new, "k")) == [("a", 1)]


def fold(times, capacity, rate):
    level, last, out = capacity, None, []
    for t in times:
        level = min(capacity, level + max(0.0, (t - (t if last is None else last)) / 1e6) * rate)
        last = t if last is None else max(last, t)
        out.append((level >= 1, 0 if level >= 1 else math.floor((1 - level) / rate) + 1))
        level -= level >= 1
    return out


def test_token_bucket_in_batch_and_stream(spark, tmp_path):
    times = {1: [0, 10, 20, 30, 2_000_000, 2_000_001, 9_000_000], 2: [5, 5, 5]}
    rows = [(k, 10**15 + t, k * 100 + i) for k, ts in times.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "k long, t long, o long")
    expect = {k * 100 + i: x for k, ts in times.items() for i, x in enumerate(fold(ts, 2.0, 0.5))}
    assert {r.o: (r.allowed, r.retry_after) for r in buckets.token_bucket(df, "k", F.col("t"), "o", 2.0, 0.5).collect()} == expect
    df.where("o % 100 < 4").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def drain():
        """All that is there, in batches that end."""
        q = stream_token_bucket(source, "k", "t", "o", 2.0, 0.5).writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        try:
            assert q.awaitTermination(120), "the stream doesn't end"
        finally:
            q.stop()

    drain()
    df.where("o % 100 >= 4").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    drain()
    assert {r.o: (r.allowed, r.retry_after) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == expect


def test_hot_and_null_keys_of_buckets(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, 1).alias("k"), (F.col("id") * 1000).alias("t"), F.col("id").alias("o"))
    got = {r.o: (r.allowed, r.retry_after) for r in buckets.token_bucket(df, "k", F.col("t"), "o", 5.0, 10.0).collect()}
    for remainder in ((0,), (1, 2)):
        ids = [i for i in range(20_000) if i % 3 in remainder]
        assert [got[i] for i in ids] == fold([i * 1000 for i in ids], 5.0, 10.0)


def test_long_date(spark):
    df = spark.createDataFrame([(datetime.date(2026, 9, 5),), (None,)], "d date")
    assert [r.x for r in df.select(tx.long_date(F.col("d")).alias("x")).collect()] == ["September 5, 2026", None]


@pytest.mark.parametrize(
    "word,expect",
    [
        ("caresses", "caress"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("gaps", "gap"), ("kiwis", "kiwi"), ("this", "this"), ("agreed", "agre"), ("plastered", "plaster"), ("hoping", "hope"), ("hopping", "hop"), ("happy", "happi"), ("say", "say"), ("by", "by"),
        ("relational", "relat"), ("conditional", "condit"), ("rationally", "ration"), ("generalizations", "general"), ("communication", "communic"), ("extension", "extens"), ("extended", "extend"), ("employment", "employ"), ("employers", "employ"), ("probate", "probat"), ("controlling", "control"),
        ("skies", "sky"), ("dying", "die"), ("news", "news"), ("inning", "inning"), ("proceeding", "proceed"), ("youth", "youth"), ("boyish", "boyish"), ("sensational", "sensat"), ("knightly", "knight"), ("triplicate", "triplic"), ("adjustment", "adjust"), ("rate", "rate"), ("cease", "ceas"), ("roll", "roll"), ("controll", "control"),
        ("été", "été"), ("i-20", "i-20"), ("", ""),
    ],
)
def test_stems(word, expect):
    assert stems.stem(word) == expect


def test_keyword_rank_by_stems(spark):
    docs = spark.createDataFrame([(1, "Extending stays", "employers extended it"), (2, "Other", None)], "id long, heading string, content string")
    asked = spark.createDataFrame([(1, "the extension of an employer"), (2, "extends")], "query_id long, text string")
    got = {(r.query_id, r.id, r.score) for r in search.keyword_rank(docs, asked, analyze=stems.lexemes(search.STOP_WORDS)).collect()}
    assert got == {(1, 1, 0.4), (2, 1, 1.4)}


def test_isolated_rows(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "t string")
    got = [tuple(r.x) for r in df.select(isolated(int, IntegerType())("t").alias("x")).collect()]
    assert got[0] == (True, 1, None) and not got[1][0] and got[1][2].startswith("ValueError") and got[2][2].startswith("TypeError")


def test_notice_parts(spark):
    cases = [("enjoined", True, DAY, ["a"], "c", "the court's order=c"), ("odd", None, None, ["a", "b"], None, "the first source=a the second source=b"), (None, None, DAY, ["a"], None, "Read the source=a"), ("not_in_force", False, None, ["a", "b"], None, "the first rule as published=a the second rule as published=b")]
    df = spark.createDataFrame(cases, "s string, e boolean, d date, u array<string>, c string, x string")
    rows = df.select("s", "x", rules.notice_parts(F.col("s"), F.col("e"), F.col("d"), F.col("u"), F.col("c")).alias("p")).collect()
    assert all(" ".join(f"{k.label}={k.url}" for k in r.p.links) == r.x for r in rows)
    assert rows[0].p.text.startswith("A rule affecting this answer was scheduled to take effect on September 15, 2026.") and rows[1].p.text == rows[2].p.text == rules.UNKNOWN
