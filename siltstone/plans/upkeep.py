"""Queries on the upkeep of a corpus: refreshes, annotations, schemas, caches, requests, and what readers are told of them.

Sources are users of events, with fetches, bodies and fields by their ids; annotated documents are those with labels.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import prose, rules as ru
from siltstone.functions import text as tx
from siltstone.operators import buckets, ledger, refresh
from siltstone.sources import crawl, manifest, snapshots

from .answers import RULES_SQL, rules, today
from .registry import joined, md5, query, table

X = F.expr


def users(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id").distinct()


# A refresh: a user is a source, its first events are attempts to fetch the document of its number, and of that document's language depends what was
# indexed before: the same text, one in small letters, another document's, or nothing. Labelled documents have chunks.
ATTEMPTS_SQL = """t AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, CASE event_type WHEN 'click' THEN 'ok' WHEN 'error' THEN 'http_error' WHEN 'view' THEN 'timeout' ELSE 'robots' END AS outcome FROM events),
f AS (SELECT id, arg_min(struct_pack(attempt, outcome), CASE WHEN outcome IN ('ok', 'robots') THEN attempt ELSE 10 - attempt END) AS x FROM t WHERE attempt <= 3 GROUP BY id),
s AS (SELECT f.id, x.attempt AS attempts, x.outcome AS outcome, d.text AS body, CASE d.lang WHEN 'en' THEN d.text WHEN 'de' THEN lower(d.text) WHEN 'fr' THEN e.text END AS old, EXISTS (FROM labels l WHERE l.doc_id = f.id) AS chunked
      FROM f JOIN documents d ON d.doc_id = f.id LEFT JOIN documents e ON e.doc_id = f.id + 1),
r AS (SELECT id, attempts, CASE WHEN outcome = 'robots' THEN 'robots_disallowed' WHEN outcome <> 'ok' OR (old IS NULL AND chunked) THEN 'fetch_failed' WHEN old IS NULL THEN 'meaningful' WHEN old = body THEN 'unchanged' WHEN lower(old) = lower(body) THEN 'cosmetic' ELSE 'meaningful' END AS status,
 CASE WHEN outcome = 'robots' THEN 'robots_disallowed' WHEN outcome <> 'ok' THEN outcome WHEN old IS NULL AND chunked THEN 'baseline_missing' WHEN old IS NULL THEN 'no_existing_snapshot' ELSE 'compared' END AS reason FROM s)"""


def fetched(spark, sf_dir):
    events, docs = table(spark, sf_dir, "events"), table(spark, sf_dir, "documents")
    tried = events.withColumn("attempt", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))).where("attempt <= 3")
    outcome = X("CASE event_type WHEN 'click' THEN 'ok' WHEN 'error' THEN 'http_error' WHEN 'view' THEN 'timeout' ELSE 'robots' END")
    rows = tried.select(F.col("user_id").alias("source_url"), "attempt", outcome.alias("outcome"), X("CASE WHEN attempt = 2 THEN 503 END").alias("http_status"))
    return refresh.settle_fetches(rows.join(docs.select(F.col("doc_id").alias("source_url"), F.col("text").alias("body")), "source_url"))


def routed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    old = X("CASE lang WHEN 'en' THEN text WHEN 'de' THEN lower(text) WHEN 'fr' THEN other END")
    sources = docs.join(after, "doc_id", "left").select(F.col("doc_id").alias("source_url"), old.alias("last_indexed_body"))
    chunks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("source_url"))
    old, new = F.col("last_indexed_body"), F.col("body")
    verdict = F.when(old == new, "unchanged").when(F.lower(old) == F.lower(new), "cosmetic").otherwise("meaningful")
    return refresh.route_sources(fetched(spark, sf_dir), sources, chunks, verdict)


@query("WITH " + ATTEMPTS_SQL + " SELECT id AS source, status, reason, CASE WHEN status IN ('fetch_failed', 'robots_disallowed') THEN 'record_failure' WHEN status = 'meaningful' THEN 'reindex' ELSE 'verify_only' END AS path FROM r")
def refresh_route(spark, sf_dir):
    return routed(spark, sf_dir).withColumnRenamed("source_url", "source")


IMPACT = "CASE WHEN id % 7 > 0 THEN id % 3 END"


@query("WITH " + ATTEMPTS_SQL + f""", i AS (SELECT *, {IMPACT} AS n FROM r) SELECT {", ".join(f"count(*) FILTER (WHERE status = '{s}')::BIGINT AS {s}" for s in refresh.TERMINAL)},
 max(CASE WHEN status = 'fetch_failed' OR status = 'meaningful' AND (n IS NULL OR n > 0) THEN 1 ELSE 0 END)::BIGINT AS exit_code FROM i""")
def refresh_report(spark, sf_dir):
    """The golden rows of a source are its id modulo 3; of every seventh source they aren't known."""
    impact = users(spark, sf_dir).withColumnRenamed("user_id", "id").where("id % 7 > 0").select(F.col("id").alias("source_url"), X("id % 3").alias("rows"))
    out = refresh.report(routed(spark, sf_dir), impact)
    return out.withColumn("exit_code", F.col("exit_code").cast("long"))


@query("WITH " + ATTEMPTS_SQL + " SELECT id AS source, rpad('host/' || id::VARCHAR, 12, ' ') || ' ' || CASE WHEN length(status) < 12 THEN rpad(status, 12, ' ') ELSE status END || ' ' || rpad(CASE WHEN id % 2 = 0 THEN 'fetched' ELSE 'resumed' END, 8, ' ') || ' ' || rpad(reason, 28, ' ') || ' ' || lpad((id % 13)::VARCHAR, 6, ' ') AS line FROM r")
def refresh_table(spark, sf_dir):
    n = F.col("source_url")
    line = refresh.report_line(F.concat(F.lit("host/"), n.cast("string")), F.col("status"), F.when(n % 2 == 0, "fetched").otherwise("resumed"), F.col("reason"), n % 13, 12)
    return routed(spark, sf_dir).select(n.alias("source"), line.alias("line"))


@query("WITH " + ATTEMPTS_SQL + """, b AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'ok' ELSE 'fetch_failed' END AS status, (id % 4)::INT AS failures, CASE WHEN id % 3 > 0 THEN 'old error' END AS error, DATE '2026-01-01' AS day FROM (SELECT DISTINCT user_id AS id FROM events) WHERE id % 11 > 0)
SELECT b.id AS source, CASE WHEN r.status IN ('unchanged', 'cosmetic', 'meaningful') THEN 'ok' ELSE coalesce(r.status, b.status) END AS status, CASE WHEN r.status IN ('unchanged', 'cosmetic', 'meaningful') THEN 0 WHEN r.status = 'fetch_failed' THEN failures + 1 ELSE failures END::BIGINT AS failures,
 CASE WHEN r.status IN ('unchanged', 'cosmetic', 'meaningful') THEN NULL ELSE coalesce(r.reason, error) END AS error, CASE WHEN r.status IN ('unchanged', 'cosmetic', 'meaningful') THEN DATE '2026-09-14' ELSE day END AS verified, CASE WHEN r.status = 'meaningful' THEN DATE '2026-09-14' ELSE day END AS changed, (CASE WHEN r.status = 'meaningful' THEN 3 ELSE 2 END)::BIGINT AS changes
FROM b LEFT JOIN (FROM r WHERE id % 2 = 0) r USING (id)""")
def source_bookkeeping(spark, sf_dir):
    """Every second source was fetched."""
    day = F.lit("2026-01-01").cast("date")
    before = users(spark, sf_dir).where("user_id % 11 > 0").select(F.col("user_id").alias("source_url"), X("CASE WHEN user_id % 3 = 0 THEN 'ok' ELSE 'fetch_failed' END").alias("status"), X("cast(user_id % 4 as int)").alias("consecutive_failures"), X("CASE WHEN user_id % 3 > 0 THEN 'old error' END").alias("last_error"), F.lit(None).cast("int").alias("last_http_status"), day.alias("last_verified_at"), day.alias("last_success_at"), day.alias("last_changed_at"), F.lit(2).alias("change_count"))
    results = routed(spark, sf_dir).where("source_url % 2 = 0").withColumn("http_status", F.lit(503))
    out = refresh.bookkeep(before, results, today())
    return out.select(F.col("source_url").alias("source"), "status", F.col("consecutive_failures").cast("long").alias("failures"), F.col("last_error").alias("error"), F.col("last_verified_at").alias("verified"), F.col("last_changed_at").alias("changed"), F.col("change_count").cast("long").alias("changes"))


@query("SELECT s.source, d.status, count(x.doc_id)::BIGINT AS n FROM (SELECT DISTINCT source FROM documents) s CROSS JOIN (VALUES ('short'), ('medium'), ('long')) d(status) LEFT JOIN (SELECT source, doc_id, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 5000 THEN 'medium' ELSE 'long' END AS status FROM documents) x ON x.source = s.source AND x.status = d.status GROUP BY ALL")
def refresh_report_counts(spark, sf_dir):
    """Counts by state, with those that are zero."""
    docs = table(spark, sf_dir, "documents").select("source", F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 5000, "medium").otherwise("long").alias("status"))
    wide = docs.groupBy("source").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("short", "medium", "long")))
    return wide.unpivot("source", ["short", "medium", "long"], "status", "n")


@query("""WITH g AS (SELECT item_id AS row, list(DISTINCT CASE WHEN doc_id % 2 = 0 THEN source ELSE 'r/' || source END) AS urls FROM benchmark JOIN documents ON doc_id IN (item_id, item_id * 2, item_id * 3) GROUP BY item_id),
s AS (SELECT DISTINCT source, CASE WHEN length(source) % 2 = 0 THEN 'r/' || source END AS resolved FROM documents)
SELECT source AS source_url, count(DISTINCT row) FILTER (WHERE list_contains(urls, source) OR coalesce(list_contains(urls, resolved), false))::BIGINT AS rows FROM s LEFT JOIN g ON true GROUP BY source""")
def golden_impact(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row"), F.explode(F.array(F.col("item_id"), F.col("item_id") * 2, F.col("item_id") * 3)).alias("doc_id"))
    golden = asked.join(docs, "doc_id").groupBy("row").agg(F.collect_set(X("CASE WHEN doc_id % 2 = 0 THEN source ELSE concat('r/', source) END")).alias("source_urls"))
    return refresh.golden_impact(docs.select(F.col("source").alias("source_url"), X("CASE WHEN length(source) % 2 = 0 THEN concat('r/', source) END").alias("resolved_url")).distinct(), golden)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 4 > 0)")
def resume_antijoin(spark, sf_dir):
    """Labels are a run's states, those of every fourth document not terminal."""
    state = table(spark, sf_dir, "labels").select(F.lit("run").alias("run_id"), F.col("doc_id").alias("source_url"), X("CASE WHEN doc_id % 4 = 0 THEN 'chunked' ELSE 'meaningful' END").alias("status"))
    return refresh.pending(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_url")), state, "run").withColumnRenamed("source_url", "doc_id")


@query("""WITH a AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE role = 'assistant'), p AS (SELECT id, k, text, CASE (id + k * 3) % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'http_error' WHEN 2 THEN 'runtime_error' WHEN 3 THEN 'other' ELSE 'ok' END AS outcome FROM a, range(0, 3) r(k)),
s AS (SELECT id, min(k) FILTER (WHERE outcome = 'ok') AS good, min(k) FILTER (WHERE outcome = 'other') AS stop, any_value(text) AS text FROM p GROUP BY id)
SELECT id AS query_id, CASE WHEN good < coalesce(stop, 9) THEN good END::BIGINT AS provider, CASE WHEN good < coalesce(stop, 9) THEN md5(good::VARCHAR || text) END AS answer, CASE WHEN good < coalesce(stop, 9) THEN NULL WHEN stop IS NOT NULL THEN 'raised' ELSE 'all_failed' END AS error FROM s""")
def provider_failover(spark, sf_dir):
    """The first of three providers that answers; only errors of the network and of the provider lead to the next one."""
    tried = table(spark, sf_dir, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"), "text")
    tried = tried.withColumn("outcome", X("CASE (query_id + k * 3) % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'http_error' WHEN 2 THEN 'runtime_error' WHEN 3 THEN 'other' ELSE 'ok' END"))
    first = tried.groupBy("query_id").agg(F.min(F.when(F.col("outcome") == "ok", F.struct("k", "text"))).alias("good"), F.min(F.when(~F.col("outcome").isin("ok", "http_error", "runtime_error"), F.col("k"))).alias("stop"))
    good = F.col("good.k") < F.coalesce("stop", F.lit(9))
    answer = md5(F.concat(F.col("good.k").cast("string"), "good.text"))
    return first.select("query_id", F.when(good, F.col("good.k").cast("long")).alias("provider"), F.when(good, answer).alias("answer"), F.when(good, F.lit(None)).when(F.col("stop").isNotNull(), "raised").otherwise("all_failed").alias("error"))


# Rules and annotations.


@query("WITH " + RULES_SQL + """, e AS (SELECT doc_id, CASE doc_id % 11 WHEN 5 THEN NULL WHEN 6 THEN 'odd' ELSE rule_status END AS status, rule_effective_date AS day, CASE WHEN doc_id % 13 > 0 THEN rule_status_source END AS source, CASE doc_id % 17 WHEN 1 THEN NULL WHEN 2 THEN 'maybe' ELSE rule_status_source_evidences_status::VARCHAR END AS evidence FROM rules)
SELECT doc_id, status IS NULL OR status = 'in_force' AS in_force, CASE WHEN source IS NOT NULL AND evidence IS NULL THEN 'source_without_evidence' WHEN source IS NOT NULL AND evidence NOT IN ('true', 'false') THEN 'evidence_not_boolean' WHEN status IS NULL AND day IS NOT NULL THEN 'date_without_status'
 WHEN status NOT IN ('in_force', 'scheduled', 'enjoined', 'not_in_force') THEN 'unknown_status' WHEN status = 'scheduled' AND day IS NULL THEN 'scheduled_without_date' WHEN status = 'scheduled' AND day <= today THEN 'scheduled_not_in_future' WHEN status = 'in_force' AND day > today THEN 'in_force_in_future'
 WHEN status IN ('enjoined', 'not_in_force') AND source IS NULL THEN 'status_without_source' END AS error FROM e, t""")
def rule_status_validate(spark, sf_dir):
    rows = rules(spark, sf_dir).select("doc_id", X("CASE doc_id % 11 WHEN 5 THEN NULL WHEN 6 THEN 'odd' ELSE rule_status END").alias("status"), F.col("rule_effective_date").alias("day"), X("CASE WHEN doc_id % 13 > 0 THEN rule_status_source END").alias("source"), X("CASE doc_id % 17 WHEN 1 THEN NULL WHEN 2 THEN 'maybe' ELSE cast(rule_status_source_evidences_status as string) END").alias("evidence"))
    s = F.col("status")
    return rows.select("doc_id", ru.in_force(s).alias("in_force"), ru.entry_error(s, F.col("day"), F.col("source"), F.col("evidence"), today()).alias("error"))


SYNC_SQL = "WITH " + RULES_SQL + """, m AS (SELECT source, arg_min(r, doc_id) AS r FROM (SELECT d.source, doc_id, struct_pack(rule_effective_date, rule_status, rule_status_source, rule_status_source_evidences_status) AS r FROM documents d JOIN rules USING (doc_id)) WHERE length(source) > 0 GROUP BY source
  UNION ALL SELECT 'nowhere', struct_pack(rule_effective_date := NULL::DATE, rule_status := 'in_force', rule_status_source := NULL::VARCHAR, rule_status_source_evidences_status := NULL::BOOLEAN)),
c AS (SELECT doc_id, source, CASE WHEN r IS NOT NULL AND (doc_id % 2 = 0 OR source < 'src2') THEN r ELSE struct_pack(rule_effective_date := NULL::DATE, rule_status := NULL::VARCHAR, rule_status_source := NULL::VARCHAR, rule_status_source_evidences_status := NULL::BOOLEAN) END AS before, r AS wanted FROM documents LEFT JOIN m USING (source)),
b AS (SELECT source, count(*) AS n, count(DISTINCT before::VARCHAR) AS kinds, bool_and(before IS NOT DISTINCT FROM wanted) AS same FROM c GROUP BY source)"""


def synced(spark, sf_dir):
    """A source's wanted annotations are those of its first document with labels; half of its documents have them."""
    docs, r = table(spark, sf_dir, "documents").select("doc_id", "source"), rules(spark, sf_dir)
    first = docs.join(r, "doc_id").groupBy("source").agg(F.min_by(F.struct(*refresh.ANNOTATIONS), "doc_id").alias("r"))
    wanted = first.select(F.col("source").alias("source_url"), "r.*")
    nowhere = spark.createDataFrame([("nowhere", None, "in_force", None, None)], wanted.schema)
    own = docs.join(first, "source", "left")
    chunks = own.select("doc_id", F.col("source").alias("source_url"), *(F.when(X("doc_id % 2 = 0 or source < 'src2'"), F.col(f"r.{c}")).alias(c) for c in refresh.ANNOTATIONS))
    return refresh.sync_annotations(wanted.unionByName(nowhere), chunks)


@query(SYNC_SQL + " SELECT m.source AS source_url, n IS NOT NULL AND NOT same AS changed, CASE WHEN NOT same THEN n ELSE 0 END::BIGINT AS documents_rows, n IS NULL AS not_in_corpus, coalesce(kinds > 1, false) AS before_is_mixed FROM m LEFT JOIN b USING (source)")
def annotation_sync_report(spark, sf_dir):
    return synced(spark, sf_dir)[1].select("source_url", "changed", F.col("documents_rows").cast("long").alias("documents_rows"), "not_in_corpus", "before_is_mixed")


@query(SYNC_SQL + " SELECT doc_id, wanted.rule_status AS status, wanted.rule_effective_date AS day FROM c")
def annotation_sync(spark, sf_dir):
    return synced(spark, sf_dir)[0].select("doc_id", F.col("rule_status").alias("status"), F.col("rule_effective_date").alias("day"))


@query("SELECT count(*)::BIGINT AS sources_considered, count(*) FILTER (WHERE n IS NOT NULL AND NOT same)::BIGINT AS changed, count(*) FILTER (WHERE n IS NULL)::BIGINT AS not_in_corpus, count(*) FILTER (WHERE same)::BIGINT AS unchanged FROM (" + SYNC_SQL + " SELECT m.source, n, same FROM m LEFT JOIN b USING (source))")
def annotation_sync_counts(spark, sf_dir):
    r = synced(spark, sf_dir)[1]
    return r.agg(F.count("*").alias("sources_considered"), F.count_if("changed").alias("changed"), F.count_if("not_in_corpus").alias("not_in_corpus"), F.count_if(~F.col("changed") & ~F.col("not_in_corpus")).alias("unchanged"))


# Sources are documents in three of the languages, labelled ones with their texts as bodies; snapshots are pages.
BACKFILL_SQL = """WITH s AS (SELECT doc_id AS id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN text END AS body FROM documents WHERE lang <> 'es'), f AS (SELECT page_id AS id, html AS snap FROM pages),
b AS (SELECT coalesce(s.id, f.id) AS source_url, CASE WHEN s.id IS NOT NULL THEN coalesce(body, snap) END AS body, CASE WHEN s.id IS NULL THEN 'no_sources_row' WHEN body IS NOT NULL AND snap IS NOT NULL THEN 'already_populated' WHEN body IS NULL AND snap IS NOT NULL THEN 'updated' WHEN body IS NOT NULL THEN 'no_snapshot' ELSE 'still_null' END AS action FROM s FULL JOIN f ON s.id = f.id) """


def backfilled(spark, sf_dir):
    had = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("had"))
    docs = table(spark, sf_dir, "documents").where("lang <> 'es'").join(had, "doc_id", "left")
    snaps = table(spark, sf_dir, "pages").select(F.col("page_id").alias("source_url"), F.col("html").alias("body"))
    return refresh.backfill(docs.select(F.col("doc_id").alias("source_url"), F.when(F.col("had"), F.col("text")).alias("last_indexed_body")), snaps)


@query(BACKFILL_SQL + "SELECT source_url, md5(body) AS last_indexed_body, action FROM b")
def body_backfill(spark, sf_dir):
    return backfilled(spark, sf_dir).withColumn("last_indexed_body", md5(F.col("last_indexed_body")))


@query(BACKFILL_SQL + "SELECT source_url FROM b WHERE action = 'still_null' ORDER BY source_url")
def unbacked_sources(spark, sf_dir):
    """Sources that have no body even after the backfill, by name."""
    return backfilled(spark, sf_dir).where("action = 'still_null'").select("source_url").orderBy("source_url")


@query("""WITH e AS (SELECT *, sum(CASE WHEN event_type NOT IN ('error', 'view') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch FROM events),
f AS (SELECT user_id, event_type, ts, event_id, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, epoch ORDER BY ts, event_id) AS n FROM e),
s AS (SELECT user_id, arg_max(n, struct_pack(ts, event_id)) AS n, arg_max(event_type, struct_pack(ts, event_id)) AS last, max(ts) FILTER (WHERE event_type NOT IN ('error', 'view')) AS ok FROM f GROUP BY user_id)
SELECT user_id AS source_id, n::BIGINT AS failures, ok AS last_success_at FROM s WHERE last = 'view' OR n >= 3 OR ok IS NULL OR epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ok) > 168 * 3600000000""")
def broken_sources(spark, sf_dir):
    checks = table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), "ts", "event_id", "event_type")
    out = ledger.failure_counts(checks, "source_id", ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "view")
    last = out.groupBy("source_id").agg(F.max(F.struct("ts", "event_id", "consecutive_failures", "event_type")).alias("x"), F.max(F.when(~F.col("event_type").isin("error", "view"), F.col("ts"))).alias("ok"))
    error = F.when(F.col("x.event_type") == "view", "robots_disallowed").otherwise("none")
    health = ledger.health(F.col("x.consecutive_failures"), error, ledger.age_hours(F.lit("2024-02-01 00:00:00").cast("timestamp"), F.col("ok")))
    return last.where(health == "broken").select("source_id", F.col("x.consecutive_failures").cast("long").alias("failures"), F.col("ok").alias("last_success_at"))


@query("""WITH e(t, c, breaks) AS (SELECT 'documents', unnest(['doc_id', 'text', 'lang', 'source', 'n_chars', 'url']), false UNION ALL SELECT 'labels', unnest(['doc_id', 'quality', 'toxic']), false UNION ALL SELECT 'gone', 'a', false),
a(t, c, breaks) AS (SELECT 'documents', unnest(['doc_id', 'text', 'lang', 'source', 'n_chars']), false UNION ALL SELECT 'labels', unnest(['doc_id', 'quality', 'toxic']), false UNION ALL SELECT 'labels', 'must', true UNION ALL SELECT 'labels', 'may', false UNION ALL SELECT 'new', 'b', true),
b AS (SELECT DISTINCT e.t FROM e JOIN a USING (t))
SELECT DISTINCT t AS table_name, NULL::VARCHAR AS column_name, 'missing_table' AS drift, true AS fatal FROM e WHERE t NOT IN (SELECT t FROM b) UNION ALL SELECT DISTINCT t, NULL, 'extra_table', false FROM a WHERE t NOT IN (SELECT t FROM b)
UNION ALL SELECT t, c, 'missing_column', true FROM e WHERE t IN (SELECT t FROM b) AND (t, c) NOT IN (SELECT t, c FROM a) UNION ALL SELECT t, c, 'extra_column', breaks FROM a WHERE t IN (SELECT t FROM b) AND (t, c) NOT IN (SELECT t, c FROM e)""")
def schema_drift(spark, sf_dir):
    """What the tables of documents and labels have, against made expectations."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    expected = crawl.catalog(spark, {"documents": docs.withColumn("url", F.lit("x")), "labels": labels, "gone": docs.select(F.col("doc_id").alias("a"))})
    actual = crawl.catalog(spark, {"documents": docs, "labels": labels.withColumns({"must": F.lit(1), "may": F.lit(None).cast("int")}), "new": docs.select(F.lit(1).alias("b"))})
    return refresh.schema_drift(expected, actual)


@query("""WITH o AS (SELECT vec_id, CASE WHEN label % 3 = 0 THEN 'v1' ELSE 'v2' END AS version FROM embeddings WHERE label < 5), n AS (SELECT vec_id, CASE lang WHEN 'en' THEN 'answer' WHEN 'de' THEN 'refusal_advice' WHEN 'fr' THEN 'clarify' ELSE 'blocked_unverified' END AS kind, text FROM embeddings JOIN documents ON doc_id = vec_id WHERE label >= 5)
SELECT vec_id AS query_id, version AS corpus_version, 'answer' AS response_type, md5('{}') AS response FROM o WHERE version = 'v2' UNION ALL SELECT vec_id, 'v2', kind, md5(text) FROM n WHERE kind IN ('answer', 'refusal_advice')""")
def semantic_cache_store(spark, sf_dir):
    """Vectors of low labels are the cache, of two versions; those of high ones are new answers, of a kind by their document's language."""
    e = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "query_id")
    cache = e.where("label < 5").select("query_id", "embedding", X("CASE WHEN label % 3 = 0 THEN 'v1' ELSE 'v2' END").alias("corpus_version"), F.lit("answer").alias("response_type"), F.lit("{}").alias("response"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), X("CASE lang WHEN 'en' THEN 'answer' WHEN 'de' THEN 'refusal_advice' WHEN 'fr' THEN 'clarify' ELSE 'blocked_unverified' END").alias("response_type"), F.col("text").alias("response"))
    new = e.where("label >= 5").select("query_id", "embedding").join(docs, "query_id")
    return refresh.store_answers(cache, new, "v2").select("query_id", "corpus_version", "response_type", md5(F.col("response")).alias("response"))


@query("SELECT source AS source_url, max(lang) AS lang, max(n_chars)::BIGINT AS n_chars, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def collapse_sources(spark, sf_dir):
    """One row of each source's documents."""
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("source_url")).agg(F.max("lang").alias("lang"), F.max(F.col("n_chars").cast("long")).alias("n_chars"), F.count("*").alias("n"))


@query("""WITH o AS (SELECT doc_id AS id, text AS body, n_chars % 5 AS changes FROM documents WHERE lang <> 'es'), n AS (SELECT page_id AS id, html AS body FROM pages)
SELECT coalesce(o.id, n.id) AS source_url, md5(coalesce(n.body, o.body)) AS body, (coalesce(o.changes, 0) + CASE WHEN length(n.body) > coalesce(length(o.body), 0) THEN 1 ELSE 0 END)::BIGINT AS changes FROM o FULL JOIN n ON o.id = n.id""")
def upsert_conditional(spark, sf_dir):
    """Documents are what sources had, and pages what a run found; only what is longer than before counts a change."""
    old = table(spark, sf_dir, "documents").where("lang <> 'es'").select(F.col("doc_id").alias("source_url"), F.col("text").alias("old"), (F.col("n_chars") % 5).alias("changes"))
    new = table(spark, sf_dir, "pages").select(F.col("page_id").alias("source_url"), F.col("html").alias("new"))
    n = F.coalesce("changes", F.lit(0)) + F.when(F.length("new") > F.coalesce(F.length("old"), F.lit(0)), 1).otherwise(0)
    return old.join(new, "source_url", "full_outer").select("source_url", md5(F.coalesce("new", "old")).alias("body"), n.cast("long").alias("changes"))


# What readers are told, and requests.


@query("""WITH s AS (SELECT user_id, max(ts) FILTER (WHERE event_type NOT IN ('error', 'view')) AS ok FROM events GROUP BY user_id), a AS (SELECT user_id, ok, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ok)) / 3.6e9::DOUBLE AS h FROM s)
SELECT user_id AS source_id, CASE WHEN h IS NULL THEN NULL WHEN h <= 24 THEN 'Sources checked today' WHEN h <= 168 THEN 'Sources checked ' || greatest(1, floor(h / 24))::BIGINT::VARCHAR || CASE WHEN greatest(1, floor(h / 24)) = 1 THEN ' day ago' ELSE ' days ago' END ELSE 'Sources last checked ' || strftime(ok, '%-d %b %Y') END AS label FROM a""")
def freshness_label(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.when(~F.col("event_type").isin("error", "view"), F.col("ts"))).alias("ok"))
    age = ledger.age_hours(F.lit("2024-02-01 00:00:00").cast("timestamp"), F.col("ok"))
    return last.select(F.col("user_id").alias("source_id"), prose.freshness_label(ledger.freshness(age), age, F.col("ok")).alias("label"))


@query("""WITH s AS (SELECT user_id % 20 AS grp, user_id, max(ts) FILTER (WHERE event_type NOT IN ('error', 'view') AND user_id % 6 > 0) AS ok, arg_max(event_type, struct_pack(ts, event_id)) = 'view' AS broken FROM events GROUP BY user_id),
g AS (SELECT grp, count(*) AS total, count(*) FILTER (WHERE broken) AS n, min(ok) FILTER (WHERE broken) AS oldest, bool_or(broken AND ok IS NULL) AS never FROM s GROUP BY grp)
SELECT grp::BIGINT AS grp, CASE WHEN n > 0 THEN n::VARCHAR || ' of ' || total::VARCHAR || CASE WHEN total = 1 THEN ' source' ELSE ' sources' END || ' not reachable' || CASE WHEN NOT never AND oldest IS NOT NULL THEN ' since ' || strftime(oldest, '%-d %b %Y') ELSE '' END END AS label FROM g""")
def broken_label(spark, sf_dir):
    """By groups of users, those whose last event is a view being broken; every sixth never worked."""
    good = ~F.col("event_type").isin("error", "view") & (F.col("user_id") % 6 > 0)
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.when(good, F.col("ts"))).alias("ok"), (F.max_by("event_type", F.struct("ts", "event_id")) == "view").alias("broken"))
    g = s.groupBy((F.col("user_id") % 20).alias("grp")).agg(F.count("*").alias("total"), F.count_if("broken").alias("n"), F.min(F.when(F.col("broken"), F.col("ok"))).alias("oldest"), F.bool_or(F.col("broken") & F.col("ok").isNull()).alias("never"))
    return g.select(F.col("grp").cast("long").alias("grp"), prose.broken_label(F.col("n"), F.col("total"), F.col("oldest"), F.col("never")).alias("label"))


@query("SELECT event_id, strftime(ts, '%b %-d, %Y') AS short, strftime(ts, '%-d %b %Y') AS day_month_year, ts::DATE = DATE '2024-01-15' AS same_day, CASE WHEN event_id % 3 > 0 THEN ts::DATE END AS parsed FROM events")
def date_formats(spark, sf_dir):
    iso = F.when(F.expr("event_id % 3 = 0"), "unknown").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, sf_dir, "events").select("event_id", tx.short_date(F.col("ts")).alias("short"), tx.day_month_year(F.col("ts")).alias("day_month_year"), F.left(F.col("ts").cast("string"), F.lit(10)).eqNullSafe(F.lit("2024-01-15")).alias("same_day"), tx.iso_day(iso).alias("parsed"))


GATE_SQL = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
b AS (SELECT user_id, i, event_id, t, 3.0::DOUBLE AS before FROM e WHERE i = 1
 UNION ALL SELECT e.user_id, e.i, e.event_id, e.t, least(3.0::DOUBLE, CASE WHEN b.before >= 1 THEN b.before - 1 ELSE b.before END + greatest(0.0::DOUBLE, (e.t - b.t)::DOUBLE / 1e6::DOUBLE) * (1.0::DOUBLE / 21600)) FROM b JOIN e ON e.user_id = b.user_id AND e.i = b.i + 1)
SELECT event_id, CASE WHEN before < 1 THEN 429 WHEN length(q) NOT BETWEEN 1 AND 4000 THEN 422 WHEN strlen(q) > 4100 THEN 413 ELSE 200 END::BIGINT AS status, CASE WHEN before < 1 THEN floor((1 - before) / (1.0::DOUBLE / 21600)) + 1 END::BIGINT AS retry_after,
 CASE WHEN before >= 1 AND length(q) BETWEEN 1 AND 4000 AND strlen(q) <= 4100 THEN md5(REDACTED) END AS question FROM (SELECT b.*, coalesce(text, '') AS q FROM b LEFT JOIN documents ON doc_id = user_id)"""
REDACTED = "q"
for pattern, name in tx.REDACTIONS:
    REDACTED = f"regexp_replace({REDACTED}, '{pattern}', '{name}', 'g')"
GATE_SQL = GATE_SQL.replace("REDACTED", REDACTED)


@query(GATE_SQL)
def gateway_decision(spark, sf_dir):
    """Requests in the order of the gateway: rate, then length, then redaction. A user's question is the document of its number, and a body may have 4,100 bytes."""
    events = table(spark, sf_dir, "events")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("user_id"), F.col("text").alias("question")).join(events.select("user_id").distinct(), "user_id", "left_semi")
    docs = docs.select("user_id", "question", md5(tx.redact(F.col("question"))).alias("asked"))  # once for each user
    rate = buckets.token_bucket(events, "user_id", F.unix_micros(F.col("ts").cast("timestamp")), "event_id", 3.0, 1.0 / 21600)
    rows = rate.join(events.select("event_id", "user_id"), ["event_id", "user_id"]).join(docs, "user_id", "left").withColumn("question", F.coalesce("question", F.lit("")))
    status = F.when(~F.col("allowed"), 429).when(~F.length("question").between(1, 4000), 422).when(F.octet_length("question") > 4100, 413).otherwise(200)
    asked = F.when(F.col("status") == 200, F.col("asked"))
    return rows.withColumn("status", status).select("event_id", F.col("status").cast("long").alias("status"), F.when(~F.col("allowed"), F.col("retry_after")).alias("retry_after"), asked.alias("question"))


@query("SELECT page_id, NOT regexp_matches(url, '^[a-z]+://[^/?#]+[.]org/en') AS allowed, page_id % 4 = 1 AS contact FROM pages")
def robots_gate(spark, sf_dir):
    """Of the pages' own hosts those in org refuse what is in English, those in net can't be read, and the others have no file."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = pages.select(crawl.host(F.col("url")).alias("host")).distinct()
    robots = hosts.where("host LIKE '%.org' OR host LIKE '%.net'").select("host", F.when(F.col("host").endswith(".org"), 200).otherwise(503).alias("status_code"), F.lit("User-agent: *\nDisallow: /en").alias("text"))
    agent = F.element_at(F.array(F.lit("Bot (+https://x.org)"), F.lit("Bot a@b.org"), F.lit("Bot a@example.com"), F.lit("Bot set-a-real-contact-here a@b.org")), X("cast(page_id % 4 as int)") + 1)
    return crawl.robots_gate(pages, robots, "bot").select("page_id", "allowed", manifest.contactable(agent).alias("contact"))


@query("SELECT doc_id, concat_ws('|', 'source_url=' || source, 'title=' || lang, 'topic=t', 'heading_note=kept') AS fields FROM documents")
def frontmatter_merge(spark, sf_dir):
    """Computed fields before a curator's; a resolved address that is no more goes."""
    existing = F.create_map(F.lit("source_url"), F.lit("old"), F.lit("resolved_url"), F.lit("old"), F.lit("heading_note"), F.lit("kept"))
    computed = F.create_map(F.lit("topic"), F.lit("t"), F.lit("title"), F.col("lang"), F.lit("source_url"), F.col("source"), F.lit("resolved_url"), F.lit(None).cast("string"))
    fields = F.transform(F.map_entries(snapshots.merge_fields(existing, computed)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return table(spark, sf_dir, "documents").select("doc_id", joined(fields, "|").alias("fields"))


@query("SELECT conv_id, turn, left('postgres://user:***@host/db ' || text, 200) AS message FROM conversations")
def error_message(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.left(tx.mask_address(F.concat(F.lit("postgres://user:secret@host/db "), "text")), F.lit(200)).alias("message"))


@query("SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'Stub answer. No context was retrieved for this question, so the sources do not cover it.' WHEN turn % 4 = 1 THEN 'Stub answer. The retrieved context addresses this question [1].' ELSE 'Stub answer. The retrieved context addresses this question [1, 2].' END || CASE WHEN turn % 4 = 0 THEN chr(10) || chr(10) || 'Ask your DSO.' ELSE '' END AS answer FROM conversations")
def stub_generate(spark, sf_dir):
    """What a generator without a model says, with a redirect where it has none and needs one."""
    said = prose.stub_answer(X("turn % 4"))
    more = F.when(X("turn % 4 = 0") & ~tx.has_redirect(said), "\n\nAsk your DSO.").otherwise("")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(said, more).alias("answer"))


@query()
def stub_embed(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", prose.embedder(64)("text").alias("embedding"))


@query()
def inline_prose(spark, sf_dir):
    t = F.concat(F.lit("## A\n- **b _c_** [1, 2]\n- [d](https://e.f)\n1. x\ntext "), "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", prose.blocks_json(t).alias("blocks"), prose.inline_json(t).alias("inline"))
