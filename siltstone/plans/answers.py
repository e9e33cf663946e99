"""Queries on answers and their passages.

Answers are what assistants say, with figures and dates put after it; an answer's passages are up to three documents with a
rule each, whose fields come from the labels.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import rules as ru
from siltstone.functions import text as tx
from siltstone.operators import answers as op

from .registry import joined, md5, query, table

TODAY = "2026-09-14"


def today():
    return F.lit(TODAY).cast("date")


def rules(spark, sf_dir):
    x = F.expr
    status = x("CASE WHEN toxic = 1 THEN 'enjoined' WHEN quality = 0 THEN 'scheduled' WHEN doc_id % 7 = 3 THEN 'not_in_force' WHEN doc_id % 2 = 0 THEN 'in_force' END")
    day = x("CASE WHEN quality = 0 OR (toxic = 1 AND doc_id % 3 = 0) OR (toxic = 0 AND doc_id % 7 <> 3 AND doc_id % 4 = 0) THEN date_add(DATE'2026-09-10', CAST(doc_id % 9 AS INT)) END")
    source = x("CASE WHEN toxic = 1 OR doc_id % 7 = 3 THEN concat('https://court.example/', doc_id % 3) END")
    evidence = x("CASE WHEN toxic = 1 OR doc_id % 7 = 3 THEN doc_id % 2 = 0 END")
    return table(spark, sf_dir, "labels").select("doc_id", status.alias("rule_status"), day.alias("rule_effective_date"), source.alias("rule_status_source"), evidence.alias("rule_status_source_evidences_status"))


def answers(spark, sf_dir):
    said = F.expr("concat(text, ' You have ', (conv_id * 3 + turn) % 50, ' days [1]. From Sept. 12, 2026 it is ', (conv_id * 3 + turn + 1) % 50, ' days, or ', (conv_id * 3 + turn + 2) % 50, ' of I-20 [2, 3].')")
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.expr("conv_id * 3 + turn").alias("base"), said.alias("answer"))


def passages(spark, sf_dir, **told):
    """``told``: functions of the content by the columns that take its place; they are made in a document's row, so that its text stays there."""
    asked = answers(spark, sf_dir).select("query_id", F.explode(F.sequence(F.col("base"), F.col("base") + 2)).alias("doc_id"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source"), F.expr("concat('Page > Part ', doc_id % 3, '\n\n', text, ' It takes ', doc_id % 50, ' days or 1,200 in May 5, 2026.')").alias("content"))
    docs = docs.select("doc_id", "source", *(f(F.col("content")).alias(k) for k, f in told.items())) if told else docs
    rows = asked.join(docs, "doc_id").join(rules(spark, sf_dir), "doc_id", "left")
    url = F.expr("concat('https://www.', source, '.gov/page-', doc_id % 2)")
    return rows.select("query_id", F.row_number().over(W.partitionBy("query_id").orderBy("doc_id")).alias("position"), "doc_id", url.alias("url"), *(told or ["content"]), F.expr("concat('Part ', doc_id % 3)").alias("heading"), *op.RULE)


def figures_sql(text: str) -> str:
    return f"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({text}, '{tx.FIGURE}', 1), lambda x: replace(coalesce(x, ''), ',', '')), lambda x: x <> '' AND NOT regexp_matches(x, '{tx.YEAR}'))))"


PARTS = r"\b((?:" + "|".join(tx.SHORT_MONTHS) + r")\.)\x01(\s+)\x02(\d)"


def parts_sql(text: str) -> str:
    return rf"string_split(regexp_replace(regexp_replace({text}, '([.!?])(\s+)', '\1' || chr(1) || '\2' || chr(2), 'g'), '{PARTS}', '\1\2\3', 'g'), chr(2))"


RULES_SQL = f"""t AS (SELECT DATE '{TODAY}' AS today),
rules AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'enjoined' WHEN quality = 0 THEN 'scheduled' WHEN doc_id % 7 = 3 THEN 'not_in_force' WHEN doc_id % 2 = 0 THEN 'in_force' END AS rule_status,
  CASE WHEN quality = 0 OR (toxic = 1 AND doc_id % 3 = 0) OR (toxic = 0 AND doc_id % 7 <> 3 AND doc_id % 4 = 0) THEN DATE '2026-09-10' + (doc_id % 9)::INT END AS rule_effective_date,
  CASE WHEN toxic = 1 OR doc_id % 7 = 3 THEN 'https://court.example/' || (doc_id % 3)::VARCHAR END AS rule_status_source,
  CASE WHEN toxic = 1 OR doc_id % 7 = 3 THEN doc_id % 2 = 0 END AS rule_status_source_evidences_status FROM labels)"""
ANSWERS_SQL = (
    "WITH " + RULES_SQL + """,
a AS (SELECT conv_id * 1000 + turn AS query_id, conv_id * 3 + turn AS base, text || ' You have ' || ((conv_id * 3 + turn) % 50)::VARCHAR || ' days [1]. From Sept. 12, 2026 it is ' || ((conv_id * 3 + turn + 1) % 50)::VARCHAR
  || ' days, or ' || ((conv_id * 3 + turn + 2) % 50)::VARCHAR || ' of I-20 [2, 3].' AS answer FROM conversations WHERE role = 'assistant'),
p AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS position, doc_id, 'https://www.' || source || '.gov/page-' || (doc_id % 2)::VARCHAR AS url,
  'Page > Part ' || (doc_id % 3)::VARCHAR || chr(10) || chr(10) || text || ' It takes ' || (doc_id % 50)::VARCHAR || ' days or 1,200 in May 5, 2026.' AS content, 'Part ' || (doc_id % 3)::VARCHAR AS heading, rules.* EXCLUDE doc_id
  FROM a JOIN documents ON doc_id BETWEEN base AND base + 2 LEFT JOIN rules USING (doc_id))"""
)
LONG_SQL = "strftime({}, '%B %-d, %Y')".format
SETS_SQL = ANSWERS_SQL + f""",
f AS (SELECT query_id, position, url, unnest({figures_sql('content')}) AS figure, rule_status IS NULL OR rule_status = 'in_force' AS now, rule_effective_date AS day, rule_status AS status FROM p),
g AS (SELECT query_id, figure, max(now) AS current FROM f GROUP BY ALL),
s0 AS (SELECT query_id, unnest({parts_sql('answer')}) AS part, unnest(range(0, len({parts_sql('answer')}))) AS i FROM a),
s AS (SELECT query_id, i, string_split(part, chr(1))[1] AS sentence, coalesce(string_split(part, chr(1))[2], '') AS separator FROM s0),
h AS (SELECT query_id, i, sentence, unnest({figures_sql('sentence')}) AS figure FROM s),
k AS (SELECT h.query_id, h.i, h.figure, g.current, f.status, f.day, f.position, f.url,
  f.status IS NOT NULL AND NOT (f.day IS NOT NULL AND regexp_matches(h.sentence, '\\b(?:' || monthname(f.day) || '|' || CASE month(f.day) WHEN 9 THEN 'Sep|Sept' ELSE left(monthname(f.day), 3) END || ')\\.?\\s+0?' || day(f.day)::VARCHAR || '\\b,?\\s+' || year(f.day)::VARCHAR || '\\b')) AS fires
  FROM h JOIN g USING (query_id, figure) LEFT JOIN f ON f.query_id = h.query_id AND f.figure = h.figure AND NOT g.current AND NOT f.now),
w AS (SELECT query_id, i, min(CASE WHEN fires THEN struct_pack(undated := day IS NULL, day := coalesce(day, DATE '9999-12-31'), status := status) END) AS way, max(current) AS current FROM k GROUP BY ALL),
q AS (SELECT query_id, i, current, CASE way.status WHEN 'scheduled' THEN 'That figure comes from a rule that takes effect on ' || {LONG_SQL('way.day')} || '. It is not the rule in force today, ' || {LONG_SQL('today')} || '.'
  WHEN 'enjoined' THEN 'That figure comes from a rule that is blocked by a court order and is not in force today, ' || {LONG_SQL('today')} || '.' ELSE 'That figure comes from a rule that is not in force today, ' || {LONG_SQL('today')} || '.' END AS said
  FROM w, t WHERE way IS NOT NULL)"""


@query(SETS_SQL + """,
u0 AS (SELECT query_id, url, min(struct_pack(i, position)) AS place FROM k JOIN q USING (query_id, i) JOIN (SELECT DISTINCT query_id, i, figure FROM k WHERE fires) x USING (query_id, i, figure) WHERE NOT q.current AND url IS NOT NULL GROUP BY ALL),
u AS (SELECT query_id, string_agg(url, ' ' ORDER BY place) AS urls FROM u0 GROUP BY query_id)
SELECT query_id, md5(string_agg(sentence || coalesce(' ' || said, '') || separator, '' ORDER BY i)) AS text, count(said)::BIGINT AS insertions, coalesce(bool_or(said IS NOT NULL AND NOT current), false) AS blocked, coalesce(max(u.urls), '') AS blocked_urls
FROM s LEFT JOIN q USING (query_id, i) LEFT JOIN u USING (query_id) GROUP BY query_id""")
def temporal_qualify_counts(spark, sf_dir):
    out = op.qualify_figures(answers(spark, sf_dir).select("query_id", "answer"), passages(spark, sf_dir), today())
    return out.select("query_id", md5(F.col("text")).alias("text"), "insertions", "blocked", joined(F.col("blocked_urls"), " ").alias("blocked_urls"))


@query(SETS_SQL + " SELECT query_id, count(*) FILTER (WHERE current)::BIGINT AS current, count(*) FILTER (WHERE NOT current)::BIGINT AS not_in_force FROM g GROUP BY query_id")
def figure_sets(spark, sf_dir):
    return op.figure_sets(passages(spark, sf_dir)).groupBy("query_id").agg(F.count_if("current").alias("current"), F.count_if(~F.col("current")).alias("not_in_force"))


NOTICES_SQL = ANSWERS_SQL + r""",
c AS (SELECT query_id, list_distinct(flatten(list_transform(regexp_extract_all(answer, '\[(\d+(?:\s*,\s*\d+)*)\]', 1), lambda s: list_transform(string_split(s, ','), lambda x: trim(x)::INT)))) AS cited FROM a),
n0 AS (SELECT p.*, list_contains(cited, position) AS hit, row_number() OVER (PARTITION BY query_id, url ORDER BY position) AS n, max(list_contains(cited, position)) OVER (PARTITION BY query_id, url) AS any_cited FROM p JOIN c USING (query_id)),
n AS (SELECT *, CASE WHEN position = 1 THEN 'top_ranked' WHEN any_cited THEN 'cited' ELSE 'retrieved' END AS reason FROM n0 WHERE n = 1 AND (rule_status IS NOT NULL OR rule_effective_date IS NOT NULL)),
g AS (SELECT query_id, rule_effective_date, rule_status, rule_status_source, rule_status_source_evidences_status, min(position) AS first, list(url ORDER BY position) AS urls FROM n GROUP BY ALL)"""


def notices(spark, sf_dir):
    cited = answers(spark, sf_dir).select("query_id", tx.cited(F.col("answer")).alias("cited"))
    return op.notices(passages(spark, sf_dir), cited)


@query(NOTICES_SQL + " SELECT query_id, url, position::BIGINT AS position, reason, rule_status FROM n")
def freshness_notices(spark, sf_dir):
    return notices(spark, sf_dir).select("query_id", "url", F.col("position").cast("long").alias("position"), "reason", "rule_status")


@query(NOTICES_SQL + " SELECT query_id, rule_effective_date AS day, rule_status AS status, rule_status_source AS source, rule_status_source_evidences_status AS evidenced, first::BIGINT AS first, array_to_string(urls, ' ') AS urls FROM g")
def notice_groups(spark, sf_dir):
    g = op.notice_groups(notices(spark, sf_dir))
    return g.select("query_id", F.col("rule_effective_date").alias("day"), F.col("rule_status").alias("status"), F.col("rule_status_source").alias("source"), F.col("rule_status_source_evidences_status").alias("evidenced"), F.col("first").cast("long").alias("first"), joined(F.col("urls"), " ").alias("urls"))


def _notice_sql() -> str:
    """The wording as SQL over g and t: subject, words by the rule's fields, and links."""
    fill = lambda s: "'" + s.replace("'", "''").replace("%d", f"' || coalesce({LONG_SQL('rule_effective_date')}, '') || '").replace("%t", f"' || {LONG_SQL('today')} || '") + "'"
    words = " ".join(f"WHEN coalesce(rule_status, 'in_force') = '{s}'{'' if e is None else f' AND coalesce(rule_status_source_evidences_status, false) = {str(e).lower()}'}{'' if d is None else f' AND (rule_effective_date IS NOT NULL) = {str(d).lower()}'} THEN {fill(w)}" for (s, e, d), w in ru.NOTICES.items())
    gone = "rule_status IN ('enjoined', 'not_in_force')"
    label = f"CASE WHEN {gone} AND NOT coalesce(rule_status_source_evidences_status, false) THEN 'rule as published' WHEN rule_status = 'enjoined' THEN 'court''s order' WHEN rule_status = 'not_in_force' THEN 'source for that' ELSE 'source' END"
    target = f"CASE WHEN {gone} AND rule_status_source IS NOT NULL THEN [rule_status_source] ELSE urls END"
    return f""", l AS (SELECT *, {label} AS label, {target} AS target FROM g),
m AS (SELECT *, list_transform(target, lambda u, i: CASE WHEN i <= 5 THEN '[the ' || ['first', 'second', 'third', 'fourth', 'fifth'][i] || ' ' ELSE '[a ' END || label || '](' || u || ')') AS many FROM l),
x AS (SELECT query_id, first, CASE WHEN len(urls) = 1 THEN 'One of the sources above describes ' ELSE 'Some of the sources above describe ' END || CASE {words} END || ' See ' ||
  CASE len(target) WHEN 1 THEN '[the ' || label || '](' || target[1] || ')' WHEN 2 THEN many[1] || ' and ' || many[2] ELSE array_to_string(many[1:-2], ', ') || ', and ' || many[-1] END || '.' AS said FROM m, t)"""


@query(NOTICES_SQL + _notice_sql() + " SELECT query_id, string_agg(said, ' ' ORDER BY first, said) AS notice FROM x GROUP BY query_id")
def notice_text(spark, sf_dir):
    return op.notice_texts(notices(spark, sf_dir), today())


def _parts_sql() -> str:
    fill = lambda s: "'" + s.replace("'", "''").replace("%d", f"' || coalesce({LONG_SQL('rule_effective_date')}, '') || '") + "'"
    words = " ".join(f"WHEN rule_status = '{s}'{'' if e is None else f' AND coalesce(rule_status_source_evidences_status, false) = {str(e).lower()}'}{'' if d is None else f' AND (rule_effective_date IS NOT NULL) = {str(d).lower()}'} THEN {fill(w)}" for (s, e, d), w in ru.SHOWN.items())
    name = "CASE WHEN NOT coalesce(rule_status_source_evidences_status, false) THEN 'rule as published' WHEN rule_status = 'enjoined' THEN 'court''s order' ELSE 'source for that' END"
    return f""", j AS (SELECT *, coalesce(rule_status IN ('enjoined', 'not_in_force'), false) AS gone, {name} AS name, CASE WHEN rule_status IN ('enjoined', 'not_in_force') AND rule_status_source IS NOT NULL THEN [rule_status_source] ELSE urls END AS target, CASE {words} ELSE '{ru.UNKNOWN}' END AS text FROM g)"""


@query(NOTICES_SQL + _parts_sql() + """ SELECT query_id, first::BIGINT AS first, text, array_to_string(list_transform(target, lambda u, i: CASE WHEN len(target) = 1 THEN CASE WHEN gone THEN 'the ' || name ELSE 'Read the source' END WHEN gone THEN CASE WHEN i <= 5 THEN 'the ' || ['first', 'second', 'third', 'fourth', 'fifth'][i] || ' ' || name ELSE 'a ' || name END
 ELSE 'the ' || CASE WHEN i <= 5 THEN ['first', 'second', 'third', 'fourth', 'fifth'][i] ELSE 'next' END || ' source' END || '=' || u), ' ') AS links FROM j""")
def ui_notices(spark, sf_dir):
    g = op.notice_groups(notices(spark, sf_dir))
    parts = ru.notice_parts(F.col("rule_status"), F.col("rule_status_source_evidences_status"), F.col("rule_effective_date"), F.col("urls"), F.col("rule_status_source"))
    rows = g.select("query_id", F.col("first").cast("long").alias("first"), parts.alias("p"))
    return rows.select("query_id", "first", "p.text", F.array_join(F.transform("p.links", lambda x: F.concat_ws("=", x["label"], x["url"])), " ").alias("links"))


NOTE_SQL = "CASE " + " ".join(
    f"WHEN (rule_status IS NOT NULL OR rule_effective_date IS NOT NULL) AND coalesce(rule_status, 'in_force') = '{s}' AND (rule_effective_date IS NOT NULL) = {str(d).lower()} THEN '"
    + w.replace("%d", f"' || coalesce({LONG_SQL('rule_effective_date')}, '') || '").replace("%t", f"' || {LONG_SQL('today')} || '") + "'"
    for (s, d), w in ru.NOTES.items()
) + " END"


@query("WITH " + RULES_SQL + f" SELECT doc_id, {NOTE_SQL} AS note FROM rules, t")
def rule_note(spark, sf_dir):
    return rules(spark, sf_dir).select("doc_id", ru.note(F.col("rule_status"), F.col("rule_effective_date"), today()).alias("note"))


@query(ANSWERS_SQL + f", b AS (SELECT query_id, position, '[' || position::VARCHAR || '] Source: ' || url || chr(10) || coalesce({NOTE_SQL} || chr(10), '') || content AS shown FROM p, t) SELECT query_id, md5(string_agg(shown, chr(10) || chr(10) ORDER BY position)) AS context FROM b GROUP BY query_id")
def context_block(spark, sf_dir):
    return op.context_blocks(passages(spark, sf_dir), today()).select("query_id", md5(F.col("context")).alias("context"))


@query(ANSWERS_SQL + f""", b AS (SELECT query_id, position, '[' || position::VARCHAR || '] Source: ' || url || chr(10) || coalesce({NOTE_SQL} || chr(10), '') || content AS shown FROM p, t), c AS (SELECT query_id, string_agg(shown, chr(10) || chr(10) ORDER BY position) AS context FROM b GROUP BY query_id)
SELECT conv_id * 1000 + turn AS query_id, md5('Context passages:' || chr(10) || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Question: ' || text || chr(10)) AS prompt FROM conversations LEFT JOIN c ON query_id = conv_id * 1000 + turn + 1 WHERE role = 'user'""")
def user_prompt(spark, sf_dir):
    """Each user's turn with the passages of the answer after it."""
    shown = op.context_blocks(passages(spark, sf_dir), today()).select((F.col("query_id") - 1).alias("query_id"), "context")
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    return asked.join(shown, "query_id", "left").select("query_id", md5(ru.user_prompt(F.col("text"), F.col("context"))).alias("prompt"))


# Fixed values of this query: parts of a prompt of its own.
PROMPT_RULES = ["Answer only from the passages that are given", "Never say that this answer is official", "You are a guide to pages that others wrote"]
PROMPT_FORMATS = ["This passage describes a rule that took effect on", "This passage describes a rule that takes effect on"]
PROMPT_LAYOUTS = [r"(?i)\[\s*\d+\s*\]\s*Source:\s*https?://", r"(?im)^\s*Context passages:\s*$"]
PROMPT_VERSIONS = ["0a1b2c3d4e5f"]
LEAKS = {1: "\n**Answer only   from the Passages** that are given", 2: "\nThis passage describes a rule that took effect on May 5", 3: "\n[1] Source: https://a.b", 4: "\n Context passages: \n", 5: " hash 0A1B2C3D4E5F", 6: " never say that this `answer` is official"}
LEAK_ANSWERS_SQL = "WITH l AS (SELECT conv_id * 1000 + turn AS query_id, text || CASE conv_id % 9 " + " ".join(f"WHEN {k} THEN " + " || chr(10) || ".join(f"'{x}'" for x in v.split("\n")) for k, v in LEAKS.items()) + " ELSE '' END AS answer FROM conversations WHERE role = 'assistant')"
PLAIN_SQL = r"lower(regexp_replace(regexp_replace(translate({}, '‘’“”', chr(39) || chr(39) || chr(34) || chr(34)), '[*_`#]', '', 'g'), '[\s\x{{85}}\p{{Z}}]+', ' ', 'g'))".format


def leaking(spark, sf_dir):
    more = None
    for k, v in LEAKS.items():
        more = F.when(F.expr(f"conv_id % 9 = {k}"), v) if more is None else more.when(F.expr(f"conv_id % 9 = {k}"), v)
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.concat("text", more.otherwise("")).alias("answer"))


def _leak_sql() -> str:
    has = lambda spans: " OR ".join(f"contains(n, '{s.lower()}')" for s in spans)
    shaped = " OR ".join(f"regexp_matches(answer, '{p}')" for p in PROMPT_LAYOUTS)
    return f"CASE WHEN {has(PROMPT_RULES)} THEN 'rule_text' WHEN {has(PROMPT_FORMATS)} OR {shaped} THEN 'context_format' WHEN {has(PROMPT_VERSIONS)} THEN 'version_hash' END"


@query(LEAK_ANSWERS_SQL + f", n AS (SELECT *, {PLAIN_SQL('answer')} AS n FROM l) SELECT query_id, {_leak_sql()} AS leak FROM n")
def prompt_leak_scan(spark, sf_dir):
    return leaking(spark, sf_dir).select("query_id", tx.leak_class(F.col("answer"), PROMPT_RULES, PROMPT_FORMATS, PROMPT_LAYOUTS, PROMPT_VERSIONS).alias("leak"))


CLAIMS = {2: " This answer is official USCIS guidance.", 3: " This is not legal advice. I am a friend.", 5: " Speaking as your immigration counsel, go.", 7: " As a USCIS officer, I say no."}


def claiming(spark, sf_dir):
    more = None
    for k, v in CLAIMS.items():
        more = F.when(F.expr(f"turn % 8 = {k}"), v) if more is None else more.when(F.expr(f"turn % 8 = {k}"), v)
    return leaking(spark, sf_dir).withColumn("turn", F.col("query_id") % 1000).select("query_id", F.concat("answer", more.otherwise("")).alias("answer"), F.expr("CASE WHEN query_id % 5 = 0 THEN 'refusal_advice' ELSE 'answer' END").alias("kind"))


#: What the appended sentences claim; texts of conversations, and the parts of prompts in them, claim nothing.
CLAIM_SQL = "CASE query_id % 1000 % 8 WHEN 2 THEN 'official_guidance' WHEN 5 THEN 'attorney_persona' WHEN 7 THEN 'agency_role' END"


@query(LEAK_ANSWERS_SQL + f" SELECT query_id, {CLAIM_SQL} AS claim FROM l")
def authority_guard(spark, sf_dir):
    return claiming(spark, sf_dir).select("query_id", tx.authority_claim("answer").alias("claim"))


CLAIMS_SQL = "CASE query_id % 1000 % 8 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in CLAIMS.items()) + " ELSE '' END"


@query(LEAK_ANSWERS_SQL + f""", m AS (SELECT query_id, answer || {CLAIMS_SQL} AS answer, {CLAIM_SQL} AS claim FROM l),
n AS (SELECT *, {PLAIN_SQL('answer')} AS n, list_distinct(flatten(list_transform(regexp_extract_all(answer, '\\[(\\d+(?:\\s*,\\s*\\d+)*)\\]', 1), lambda s: list_transform(string_split(s, ','), lambda x: trim(x)::INT)))) AS cited,
 CASE WHEN query_id % 5 = 0 THEN 'refusal_advice' ELSE 'answer' END AS kind FROM m)
SELECT query_id, CASE WHEN len(list_filter(cited, lambda x: x < 1 OR x > 1)) > 0 THEN 'citation_index_out_of_range' WHEN kind = 'answer' AND len(cited) = 0 THEN 'answer_missing_citation'
 WHEN claim IS NOT NULL THEN 'answer_claims_official_authority' WHEN {_leak_sql()} IS NOT NULL THEN 'answer_reproduces_system_prompt' END AS failed FROM n""")
def first_failing_check(spark, sf_dir):
    leak = tx.leak_class(F.col("answer"), PROMPT_RULES, PROMPT_FORMATS, PROMPT_LAYOUTS, PROMPT_VERSIONS)
    cited = tx.citation_reason(tx.cited(F.col("answer")), F.lit(1), F.col("kind"))
    return claiming(spark, sf_dir).select("query_id", op.first_failing_check(cited, tx.authority_claim("answer"), leak).alias("failed"))


# Questions of users with signals by their ids, for the route.
QUESTION = "CASE conv_id % 8 WHEN 1 THEN 'こんにちは 世界' WHEN 2 THEN 'What is OPT?' WHEN 3 THEN '延长 OPT 需要 多少 时间 呢 请 告诉 我' WHEN 4 THEN 'OPT extension' ELSE text END"
WORDS_SQL = r"list_filter(list_transform(string_split_regex(question, '[\s\x{85}\p{Z}]+'), lambda w: lower(regexp_replace(w, '^[\p{P}\p{S}]+|[\p{P}\p{S}]+$', '', 'g'))), lambda w: w <> '' AND w NOT IN (" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + "))"
OTHER_SQL = r"regexp_matches(regexp_replace(question, '\p{Latin}', '', 'g'), '\p{L}')"
QUESTIONS_SQL = f"WITH q0 AS (SELECT conv_id * 1000 + turn AS query_id, {QUESTION} AS question FROM conversations WHERE role = 'user'), q AS (SELECT *, {WORDS_SQL} AS words FROM q0), " + rf"""
v AS (SELECT *, {OTHER_SQL} AND len(list_filter(words, lambda w: regexp_matches(w, '\p{{Latin}}'))) = 0 AS other_script,
 CASE WHEN regexp_matches(question, '{tx.RUN_ON}') THEN length(regexp_replace(question, '[\s\x{{85}}\p{{Z}}\p{{P}}\p{{S}}]', '', 'g')) < 10 ELSE len(words) < 3 AND NOT (len(words) >= 2 AND list_has_any(words, [{", ".join(f"'{w}'" for w in tx.ANCHORS)}])) END AS too_vague FROM q)"""


def asked(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.expr(QUESTION).alias("question"))


@query(QUESTIONS_SQL + " SELECT query_id, len(words)::BIGINT AS words, too_vague FROM v")
def clarify_gate(spark, sf_dir):
    q = F.col("question")
    return asked(spark, sf_dir).select("query_id", F.size(tx.content_words(q)).cast("long").alias("words"), tx.too_vague(q).alias("too_vague"))


@query(QUESTIONS_SQL + f" SELECT query_id, other_script, {OTHER_SQL} AS other_letter FROM v")
def script_gate(spark, sf_dir):
    return asked(spark, sf_dir).select("query_id", tx.other_script(F.col("question")).alias("other_script"), tx.other_letter(F.col("question")).alias("other_letter"))


ROUTE = {
    "cached_type": "CASE WHEN query_id % 11 = 0 THEN 'answer' WHEN query_id % 13 = 0 THEN 'refusal_advice' END", "contexts": "CASE WHEN query_id % 17 = 0 THEN 0 ELSE 5 END",
    "min_distance": "CASE WHEN query_id % 17 <> 0 THEN (query_id % 60) / 100.0D END", "over_budget": "query_id % 19 = 0", "is_advice": "query_id % 3 = 0",
    "failed": "CASE WHEN query_id % 7 = 0 THEN 'citation_index_out_of_range' WHEN query_id % 23 = 0 THEN 'answer_reproduces_system_prompt' END", "blocked": "query_id % 29 = 0",
}


@query(QUESTIONS_SQL + ", r AS (SELECT *, " + ", ".join(f"{v.replace('100.0D', '100.0::DOUBLE')} AS {k}" for k, v in ROUTE.items()) + f""" FROM v)
SELECT query_id, {OTHER_SQL} AS question_other_script, CASE WHEN other_script THEN 'no_answer' WHEN too_vague THEN 'clarify' WHEN cached_type IS NOT NULL THEN cached_type WHEN contexts = 0 OR min_distance > 0.5 OR over_budget THEN 'no_answer'
 WHEN failed IS NOT NULL OR blocked THEN 'blocked_unverified' WHEN is_advice THEN 'refusal_advice' ELSE 'answer' END AS response_type,
CASE WHEN other_script THEN 'non_latin_script_unsupported' WHEN too_vague THEN 'query_too_vague' WHEN cached_type IS NOT NULL THEN CASE cached_type WHEN 'refusal_advice' THEN 'query_asks_for_personal_advice' END WHEN contexts = 0 THEN 'no_chunks_retrieved'
 WHEN min_distance > 0.5 THEN 'min_distance_exceeds_threshold' WHEN over_budget THEN 'daily_generation_cap_reached' WHEN failed IS NOT NULL THEN failed WHEN blocked THEN 'answer_states_not_in_force_rule_as_current' WHEN is_advice THEN 'query_asks_for_personal_advice' END AS refusal_reason FROM r""")
def answer_route(spark, sf_dir):
    rows = asked(spark, sf_dir).withColumns({k: F.expr(v) for k, v in ROUTE.items()})
    return op.route(rows).select("query_id", "question_other_script", "response_type", "refusal_reason")


@query(QUESTIONS_SQL + """, r AS (SELECT query_id, CASE WHEN other_script THEN 'no_answer' WHEN query_id % 7 = 0 THEN 'blocked_unverified' WHEN too_vague THEN 'no_answer' ELSE 'answer' END AS kind,
 CASE WHEN other_script THEN 'non_latin_script_unsupported' WHEN query_id % 14 = 0 THEN 'answer_reproduces_system_prompt' WHEN query_id % 7 = 0 THEN 'answer_missing_citation' WHEN too_vague THEN 'no_chunks_retrieved' END AS reason FROM v)
SELECT query_id, CASE WHEN kind IN ('no_answer', 'blocked_unverified') THEN CASE reason WHEN 'non_latin_script_unsupported' THEN 'This tool only reads English right now' WHEN 'answer_reproduces_system_prompt' THEN 'This answer repeated this tool''s own instructions, so we blocked it'
 ELSE CASE kind WHEN 'no_answer' THEN 'Where to look instead' ELSE 'This answer didn''t pass our citation check' END END END AS heading FROM r""")
def withheld_copy(spark, sf_dir):
    q, n = F.col("question"), F.col("query_id")
    other, vague = tx.other_script(q), tx.too_vague(q)
    kind = F.when(other, "no_answer").when(n % 7 == 0, "blocked_unverified").when(vague, "no_answer").otherwise("answer")
    reason = F.when(other, "non_latin_script_unsupported").when(n % 14 == 0, "answer_reproduces_system_prompt").when(n % 7 == 0, "answer_missing_citation").when(vague, "no_chunks_retrieved")
    return asked(spark, sf_dir).select("query_id", op.heading_of(kind, reason).alias("heading"))


FLAT_SQL = r"trim(regexp_replace(regexp_replace(regexp_extract(content, '^[\s\S]*?\n\s*\n([\s\S]*)$', 1), '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\s+', ' ', 'g'))"


@query(ANSWERS_SQL + rf""", c AS (SELECT *, {FLAT_SQL} AS flat, trim(regexp_replace(content, '\s+', ' ', 'g')) AS folded FROM p),
d AS (SELECT *, CASE WHEN length(folded) <= 240 THEN folded ELSE regexp_replace(left(folded, 240), '\s\S*$', '') || '...' END AS snippet FROM c)
SELECT query_id, position::BIGINT AS index, heading AS title, CASE WHEN length(flat) < 40 THEN snippet WHEN length(flat) <= 240 THEN flat ELSE regexp_replace(left(flat, 240), '\s+\S*$', '') || '...' END AS quote, url, regexp_replace(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '^www\.', '') AS domain,
 strftime(DATE '2026-01-05' + (position)::INT, '%b %-d, %Y') AS updated, CASE WHEN position = 1 THEN 'today' ELSE strftime(DATE '2026-09-15' - position::INT, '%b %-d, %Y') END AS verified FROM d""")
def source_cards(spark, sf_dir):
    p = passages(spark, sf_dir, snippet=tx.snippet, quote=tx.quote_of_chunk)
    cited = p.select("query_id", F.col("position").cast("long").alias("position"), F.col("doc_id").alias("chunk_id"), "url", "snippet")
    held = p.select("query_id", F.col("doc_id").alias("chunk_id"), F.col("position").alias("ordinal"), "heading", "quote")
    days = p.withColumn("url", F.col("url")).select("query_id", "url", F.col("position").alias("ordinal"), F.expr("date_add(DATE'2026-01-05', position)").alias("page_last_updated"), F.expr("date_sub(DATE'2026-09-15', position)").alias("last_verified_at"))
    # each passage has an address of its own here, so that its own days show
    own = lambda df, n: df.withColumn("url", F.concat("url", F.lit("#"), F.col(n).cast("string")))
    return op.source_cards(own(cited, "position"), held, own(days, "ordinal"), today()).withColumn("url", F.regexp_replace("url", "#.*$", ""))


@query(ANSWERS_SQL + " SELECT query_id, position::BIGINT AS position, CASE WHEN doc_id % 3 = 0 THEN 'https://moved.org/' || doc_id::VARCHAR ELSE url END AS url FROM p")
def citation_urls(spark, sf_dir):
    """The address that a source led to, where it led to another; an empty one is none."""
    moved = F.expr("CASE WHEN doc_id % 3 = 0 THEN concat('https://moved.org/', doc_id) WHEN doc_id % 3 = 1 THEN '' END")
    return passages(spark, sf_dir).select("query_id", F.col("position").cast("long").alias("position"), tx.citation_url(moved, F.col("url")).alias("url"))


@query(ANSWERS_SQL + " SELECT query_id, position::BIGINT AS position, rule_status AS status, rule_effective_date AS day FROM p")
def response_json(spark, sf_dir):
    """Passages as a cached response holds them, and read back from it."""
    kind = "array<struct<position:bigint,status:string,day:date>>"
    held = F.to_json(F.array_sort(F.collect_list(F.struct(F.col("position").cast("long").alias("position"), F.col("rule_status").alias("status"), F.col("rule_effective_date").alias("day")))))
    cached = passages(spark, sf_dir).groupBy("query_id").agg(held.alias("response"))
    return cached.select("query_id", F.explode(F.from_json("response", kind)).alias("c")).select("query_id", "c.*")


@query("SELECT doc_id, metric, CASE metric WHEN 0 THEN quality WHEN 1 THEN toxic ELSE n_chars END::BIGINT AS score FROM labels JOIN documents USING (doc_id), range(0, 3) m(metric)")
def metric_zip(spark, sf_dir):
    """Jobs by number, three metrics of each labelled document, brought back to their rows: number // 3 is the row, number % 3 the metric."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    each = F.array(*(F.col(c).cast("long") for c in ("quality", "toxic", "n_chars")))
    done = rows.select("doc_id", F.posexplode(each).alias("m", "score")).select((F.col("doc_id") * 3 + F.col("m")).alias("job"), "score")
    return rows.select("doc_id").join(done.withColumn("doc_id", F.expr("job div 3")), "doc_id").select("doc_id", (F.col("job") % 3).alias("metric"), "score")
