"""Queries over several operators at once: retrieved rows, responses, traces, clients and bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import parse
from siltstone.operators import pipeline, search, text_index, traces
from siltstone.sources import networks
from siltstone.streaming import sinks

from . import stores
from .answers import QUESTION, QUESTIONS_SQL
from .catalogue import ADVICE_SQL, FUSED_SQL, fused, tokens_sql
from .registry import md5, query, table

# Responses: each user's turn is asked twice, of every second conversation first, whose answers are the cache of the second time.

SECRET, CAP = "of the", 60
RESPOND_SQL = QUESTIONS_SQL.replace(QUESTION, "text") + f""",
s AS (SELECT query_id, question, other_script, too_vague, list_distinct({tokens_sql("question")}) AS lexemes FROM v),
p AS (SELECT doc_id AS id, unnest({tokens_sql("string_split(text, chr(10))[1]")}) AS lexeme, 1 AS head FROM documents UNION ALL SELECT doc_id, unnest({tokens_sql("text")}), 0 FROM documents),
g AS (SELECT id, lexeme, sum(head) AS a, sum(1 - head) AS b FROM p GROUP BY ALL),
u AS (SELECT query_id, unnest(lexemes) AS lexeme FROM s WHERE NOT other_script AND NOT too_vague),
k0 AS (SELECT query_id, id, sum(a) AS a, sum(b) AS b FROM u JOIN g USING (lexeme) GROUP BY query_id, id),
k AS (SELECT query_id, id, round(a::DOUBLE * 1.0::DOUBLE + b::DOUBLE * 0.4::DOUBLE, 6) AS score FROM k0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY 5 * a + 2 * b DESC, id) <= 5),
h AS (SELECT query_id, count(*) AS contexts, max(score) AS best, arg_min(regexp_replace(left(text, 100), '\\s+', ' ', 'g'), struct_pack(s := -score, id)) AS lead FROM k JOIN documents ON doc_id = id GROUP BY query_id),
f AS (SELECT s.*, coalesce(contexts, 0) AS contexts, best, 'Stub answer. The retrieved context addresses this question ' || CASE WHEN contexts = 1 THEN '[1]' ELSE '[1, 2]' END || '. ' || lead AS answer FROM s LEFT JOIN h USING (query_id)),
j AS (SELECT *, contains(lower(regexp_replace(regexp_replace(answer, '[*_`#]', '', 'g'), '\\s+', ' ', 'g')), '{SECRET}') AS leaks, {ADVICE_SQL.replace("q,", "lower(question),")} AS advice FROM f),
t AS (SELECT *, CASE WHEN other_script THEN 'no_answer' WHEN too_vague THEN 'clarify' WHEN contexts = 0 OR best < {pipeline.LEAST} THEN 'no_answer' WHEN leaks THEN 'blocked_unverified' WHEN advice THEN 'refusal_advice' ELSE 'answer' END AS kind,
 CASE WHEN other_script THEN 'non_latin_script_unsupported' WHEN too_vague THEN 'query_too_vague' WHEN contexts = 0 THEN 'no_chunks_retrieved' WHEN best < {pipeline.LEAST} THEN 'min_distance_exceeds_threshold' WHEN leaks THEN 'answer_reproduces_system_prompt' WHEN advice THEN 'query_asks_for_personal_advice' END AS reason FROM j),
z AS (SELECT *, (query_id // 1000) % 2 = 0 AND kind IN ('answer', 'refusal_advice') AS cached FROM t),
b AS (SELECT *, sum((NOT cached AND kind IN ('answer', 'refusal_advice', 'blocked_unverified'))::INT) OVER (ORDER BY query_id) AS n, NOT cached AND kind IN ('answer', 'refusal_advice', 'blocked_unverified') AS generated FROM z)
SELECT query_id, CASE WHEN generated AND n > {CAP} THEN 'no_answer' ELSE kind END AS response_type, CASE WHEN generated AND n > {CAP} THEN 'daily_generation_cap_reached' ELSE reason END AS refusal_reason,
 (CASE WHEN cached OR other_script OR too_vague THEN 0 ELSE contexts END)::BIGINT AS contexts, CASE WHEN kind IN ('answer', 'refusal_advice') AND NOT (generated AND n > {CAP}) THEN md5(answer) END AS answer FROM b"""


@query(RESPOND_SQL)
def answer_pipeline(spark, sf_dir):
    """Of users' turns and whole documents: gates, cache, keyword retrieval from the stored index, budget, stub, checks."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("question"))
    root, docs = stores.texts_of(spark, sf_dir), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))

    def retrieve(questions):
        found = text_index.rank(spark, root, questions, 5, number=1)
        return found.join(docs.select("id"), "id").select("query_id", F.col("rank").alias("position"), "id", "score")

    def generate(asked):
        return pipeline.stub(asked, docs)

    before = asked.where(F.floor(F.col("query_id") / 1000) % 2 == 0)
    cache = pipeline.cacheable(pipeline.respond(before, retrieve, generate, secrets=[SECRET]), before)
    out = pipeline.respond(asked, retrieve, generate, cache, cap=CAP, secrets=[SECRET])
    return out.select("query_id", "response_type", "refusal_reason", F.col("contexts").cast("long").alias("contexts"), md5(F.col("answer")).alias("answer"))


# Retrieved rows with their sources. A source's row is made of its documents.

SOURCES_SQL = "src AS (SELECT source, 'https://' || source || '.org/page?n=' || count(*) AS resolved_url, DATE '2026-01-01' + (sum(n_chars) % 200)::INT AS page_last_updated, DATE '2026-06-01' + (count(*) % 30)::INT AS fetched_at, DATE '2026-06-01' + (max(doc_id) % 90)::INT AS last_verified_at FROM documents GROUP BY source)"


def sources(spark, sf_dir):
    day = lambda base, n: F.date_add(F.lit(base).cast("date"), n.cast("int"))
    own = table(spark, sf_dir, "documents").groupBy("source").agg(
        F.concat(F.lit("https://"), F.col("source"), F.lit(".org/page?n="), F.count("*").cast("string")).alias("resolved_url"),
        day("2026-01-01", F.sum("n_chars") % 200).alias("page_last_updated"), day("2026-06-01", F.count("*") % 30).alias("fetched_at"), day("2026-06-01", F.max("doc_id") % 90).alias("last_verified_at"),
    )
    return own.withColumnRenamed("source", "source_url")


@query(FUSED_SQL + ", " + SOURCES_SQL + """ SELECT query_id, position::BIGINT AS position, top.id, source AS source_url, resolved_url, md5(string_split(text, chr(10))[1]) AS section_heading, page_last_updated, quality AS rule_quality, fetched_at, last_verified_at, rrf_score
FROM top JOIN documents ON doc_id = top.id JOIN src USING (source) LEFT JOIN labels USING (doc_id)""")
def retrieved_rows(spark, sf_dir):
    """The best rows of both arms, each with its chunk's and its source's fields."""
    chunks = stores.chunks(spark, sf_dir).select("id", "source_url", md5(F.col("heading")).alias("section_heading"))
    notes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("rule_quality"))
    top = search.best(fused(spark, sf_dir)).select("query_id", F.col("position").cast("long").alias("position"), "id", "rrf_score")
    return search.retrieved(top, chunks.join(notes, "id", "left"), sources(spark, sf_dir))


# Stage events: what a user does until a purchase or an error, with less than a day between, is a request.

STAGE = "CASE event_type WHEN 'purchase' THEN 'result' WHEN 'click' THEN 'retrieve' WHEN 'view' THEN 'classify' ELSE event_type END"


@query(f"""WITH e AS (SELECT user_id::VARCHAR AS request_id, ts, event_id, {STAGE} AS event, props, epoch_us(ts) AS us FROM events),
g AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY request_id ORDER BY ts, event_id) > 86400000000, false) AS gap FROM e),
n AS (SELECT *, sum(gap::INT) OVER (PARTITION BY request_id ORDER BY ts, event_id) AS nth FROM g),
k AS (SELECT *, event IN ('result', 'error') AS ends, coalesce(sum((event IN ('result', 'error'))::INT) OVER (PARTITION BY request_id, nth ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM n),
m AS (SELECT *, lead(us) OVER w - us AS micros, row_number() OVER w AS place FROM k WHERE over = 0 WINDOW w AS (PARTITION BY request_id, nth ORDER BY ts, event_id)),
s AS (SELECT request_id, nth, event, min(place) AS place, sum(micros) AS micros FROM m WHERE NOT ends GROUP BY ALL),
t AS (SELECT request_id, nth, string_agg(event || '=' || coalesce(micros::BIGINT::VARCHAR, ''), ' ' ORDER BY place) AS stages FROM s GROUP BY ALL)
SELECT request_id, min(ts) AS started, max(ts) AS ended, coalesce(max(event) FILTER (WHERE ends), 'incomplete') AS outcome, max(props) FILTER (WHERE ends) AS detail, count(*)::BIGINT AS events, coalesce(any_value(stages), '') AS stages FROM m LEFT JOIN t USING (request_id, nth) GROUP BY request_id, nth""")
def stage_trace(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("request_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.expr(STAGE).alias("event"), F.col("props").alias("detail"))
    out = traces.traces(events, 86_400)
    stages = F.array_join(F.transform("stages", lambda s: F.concat(s["stage"], F.lit("="), F.coalesce(s["micros"].cast("string"), F.lit("")))), " ")
    return out.select("request_id", "started", "ended", "outcome", "detail", "events", stages.alias("stages"))


# Clients: a request comes from an address of either family, and customers are the networks of trusted proxies.

PEER = "CASE event_id % 4 WHEN 0 THEN '10.' || (user_id % 256) || '.' || (event_id % 256) || '.9' WHEN 1 THEN '2001:db8:' || {x} || '::' || {y} WHEN 2 THEN '::ffff:10.' || (user_id % 256) || '.' || (event_id % 256) || '.7' ELSE 'host-' || user_id END"
SEEN = "CASE event_id % 5 WHEN 0 THEN '203.0.113.' || (event_id % 300) || ', 10.0.0.1' WHEN 1 THEN ' 2001:db8::' || {y} || ' ' WHEN 2 THEN props WHEN 3 THEN '2001:db8:::1' END"
HEX = {"duckdb": {"x": "printf('%x', user_id % 65536)", "y": "printf('%x', event_id % 65536)"}, "spark": {"x": "lower(hex(user_id % 65536))", "y": "lower(hex(event_id % 65536))"}}


@query(f"""WITH c AS (SELECT DISTINCT c_custkey AS k FROM customer),
e AS (SELECT *, {PEER.format(**HEX["duckdb"])} AS peer, trim({SEEN.format(**HEX["duckdb"])}) AS seen FROM events),
t AS (SELECT *, CASE WHEN event_id % 4 IN (0, 2) THEN EXISTS (FROM c WHERE k % 2 = 0 AND (k // 2) % 256 = user_id % 256 AND (k // 512) % 16 = (event_id % 256) // 16) WHEN event_id % 4 = 1 THEN EXISTS (FROM c WHERE k % 2 = 1 AND k % 65536 = user_id % 65536) ELSE false END AS trusted FROM e)
SELECT event_id, CASE WHEN trusted AND (event_id % 5 = 0 AND event_id % 300 < 256 OR event_id % 5 = 1) THEN split_part(seen, ',', 1) ELSE peer END AS client FROM t""")
def client_ip(spark, sf_dir):
    """Each customer is a network: those of even keys one of 20 bits of the old family, the others one of 48 bits."""
    old = "concat('10.', (c_custkey div 2) % 256, '.', ((c_custkey div 512) % 16) * 16, '.0/20')"
    nets = table(spark, sf_dir, "customer").select(F.expr(f"CASE WHEN c_custkey % 2 = 0 THEN {old} ELSE concat('2001:db8:', lower(hex(c_custkey % 65536)), '::/48') END").alias("network"))
    requests = table(spark, sf_dir, "events").select("event_id", F.expr(PEER.format(**HEX["spark"])).alias("peer"), F.expr(SEEN.format(**HEX["spark"])).alias("forwarded"))
    return networks.clients(requests, nets).select("event_id", "client")


# Bookkeeping of many results at once: a user is a source, and events are results of its fetches.

FOLD_SQL = """WITH e AS (SELECT *, event_type NOT IN ('error', 'view') AS good, struct_pack(ts, event_id) AS place FROM events),
w AS (SELECT user_id, max(place) FILTER (WHERE good) AS since, max(ts) FILTER (WHERE good) AS ok, max(ts) FILTER (WHERE event_type = 'purchase') AS changed, count(*) FILTER (WHERE event_type = 'purchase') AS changes, arg_max(event_type, place) AS last FROM e GROUP BY user_id),
f AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error' AND (since IS NULL OR place > since)) AS fails, arg_max(props, place) FILTER (WHERE NOT good AND (since IS NULL OR place > since)) AS why FROM e JOIN w USING (user_id) GROUP BY user_id)
SELECT user_id::VARCHAR AS source_url, CASE last WHEN 'error' THEN 'fetch_failed' WHEN 'view' THEN 'robots_disallowed' ELSE 'ok' END AS status, (fails + CASE WHEN ok IS NULL THEN 1 ELSE 0 END)::BIGINT AS failures, CASE WHEN last IN ('error', 'view') THEN why END AS error, ok AS verified, changed, changes::BIGINT AS changes FROM w JOIN f USING (user_id)"""


@query(FOLD_SQL)
def bookkeeping_fold(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    when = F.col("ts").cast("timestamp")
    kind = F.when(F.col("event_type") == "error", "fetch_failed").when(F.col("event_type") == "view", "robots_disallowed").when(F.col("event_type") == "purchase", "meaningful").otherwise("unchanged")
    results = events.select(F.col("user_id").cast("string").alias("source_url"), F.col("event_id").alias("seq"), when.alias("at"), kind.alias("status"), F.col("props").alias("reason"), F.lit(500).alias("http_status"))
    none = {"last_http_status": "int", "last_verified_at": "timestamp", "last_success_at": "timestamp", "last_changed_at": "timestamp"}
    before = events.select(F.col("user_id").cast("string").alias("source_url")).distinct().select("source_url", F.lit("ok").alias("status"), F.lit(1).alias("consecutive_failures"), F.lit("old").alias("last_error"), *(F.lit(None).cast(t).alias(c) for c, t in none.items()), F.lit(0).alias("change_count"))
    out = sinks.bookkeep_all(before, results)
    local = lambda c: F.col(c).cast("timestamp_ntz")
    return out.select("source_url", "status", F.col("consecutive_failures").cast("long").alias("failures"), F.col("last_error").alias("error"), local("last_verified_at").alias("verified"), local("last_changed_at").alias("changed"), F.col("change_count").cast("long").alias("changes"))


# Typed tokens of whole documents, by a join with the vocabulary of their different runs. The SQL finds each type by a pattern of its own.

W_, L_, N_ = r"[\p{L}\p{Nd}]", r"\p{L}", r"\p{Nd}"
LABEL = rf"{W_}+(?:-{W_}+)*"
HOST = rf"{LABEL}(?:\.{LABEL})*\.(?:{W_}+-)*{W_}*{L_}"
EMAIL = rf"{LABEL}(?:\.{LABEL})*@{W_}(?:{W_}|-)*(?:\.{W_}(?:{W_}|-)*)*\.{L_}{W_}*"
WHOLE = rf"{HOST}/\S*|{L_}+://"
PLAIN = rf"{N_}+\.{N_}+(?:\.{N_}+)+|{HOST}|{N_}+\.{N_}+|{W_}+(?:-{W_}+)*-{N_}*{L_}{W_}*|{W_}+"
#: A sign is a number's own only where no token ends before it, so that tokens are found with a sign after them.
TOKENS = rf"[+-]{N_}+(?:\.{N_}+)?|{EMAIL}[+-]?|{WHOLE}|(?:{PLAIN})[+-]?"
BARE = rf"CASE WHEN regexp_full_match(x, '{WHOLE}') THEN x ELSE regexp_replace(x, '(.)[+-]$', '\1') END"
TYPE = rf"""CASE WHEN regexp_full_match(x, '[+-]{N_}+') THEN 'int' WHEN regexp_full_match(x, '[+-].*') THEN 'float' WHEN regexp_full_match(x, '{EMAIL}') THEN 'email' WHEN regexp_full_match(x, '{L_}+://') THEN 'protocol' WHEN regexp_full_match(x, '{HOST}/\S*') THEN 'url' WHEN regexp_full_match(x, '{N_}+') THEN 'uint' WHEN regexp_full_match(x, '{N_}+\.{N_}+') THEN 'float'
 WHEN regexp_full_match(x, '{N_}+\.{N_}+(\.{N_}+)+') THEN 'version' WHEN contains(x, '.') THEN 'host' WHEN contains(x, '-') THEN CASE WHEN regexp_matches(x, '{N_}') THEN 'numhword' ELSE 'hword' END WHEN regexp_full_match(x, '{L_}+') THEN 'word' ELSE 'numword' END"""


@query(rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '{TOKENS}')) AS x FROM documents), b AS (SELECT doc_id, {BARE} AS x FROM t), k AS (SELECT doc_id, x, {TYPE} AS type FROM b),
s AS (SELECT doc_id, type, x FROM k
 UNION ALL SELECT doc_id, CASE WHEN regexp_full_match(p, '{L_}+') THEN 'part' WHEN regexp_full_match(p, '{N_}+') THEN 'uint' ELSE 'numpart' END, p FROM (SELECT doc_id, unnest(string_split(x, '-')) AS p FROM k WHERE type IN ('hword', 'numhword'))
 UNION ALL SELECT doc_id, 'host', split_part(x, '/', 1) FROM k WHERE type = 'url' UNION ALL SELECT doc_id, 'path', x[strpos(x, '/') :] FROM k WHERE type = 'url')
SELECT doc_id, type, count(*)::BIGINT AS n, md5(string_agg(DISTINCT x, '|' ORDER BY x)) AS tokens FROM s GROUP BY doc_id, type""")
def token_types(spark, sf_dir):
    found = parse.typed_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", search.STOP_WORDS)
    return found.groupBy("doc_id", "type").agg(F.count("*").alias("n"), md5(F.array_join(F.array_sort(F.collect_set("token")), "|")).alias("tokens"))
