"""Queries over the test tables, one or more for each operator, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import html as ht
from siltstone.functions import prose
from siltstone.functions import text as tx
from siltstone.operators import buckets, evals, ingest, ledger, search, text_index, vector_index
from siltstone.sources import scratch

from . import stores
from .answers import figures_sql, parts_sql
from .registry import ORACLE_SQL, QUERIES, joined, md5, query, table

__all__ = ["ORACLE_SQL", "QUERIES"]


# Retrieval. Rows are documents with vectors of the same id; questions are the rows whose id is divisible by 20.


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def questions(spark, sf_dir):
    """Vectors, each with the text of a benchmark's item."""
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return asked.join(table(spark, sf_dir, "benchmark").select((F.col("item_id") * 20).alias("query_id"), "text"), "query_id", "left")


def dates(spark, sf_dir):
    return table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("id"), F.date_add(F.lit("2026-01-01").cast("date"), (F.col("doc_id") % 5).cast("int")).alias("day"))


def fused(spark, sf_dir):
    """The candidates of both arms, written once for all that is made of them."""
    q = questions(spark, sf_dir)
    return scratch.written(search.fuse(search.nearest(vectors(spark, sf_dir), q.select("query_id", "embedding")), keywords(spark, sf_dir)), "fused")


def keywords(spark, sf_dir, analyzer="simple"):
    """The keyword arm, from the stored index."""
    return text_index.rank(spark, stores.texts_of(spark, sf_dir, analyzer), questions(spark, sf_dir).select("query_id", "text"), number=1)


def tokens_sql(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in search.STOP_WORDS)
    return f"list_filter(regexp_extract_all(lower({text}), '{search.TOKEN}'), lambda w: w NOT IN ({stop}))"


FUSED_SQL = f"""
WITH q AS (SELECT vec_id AS query_id, embedding AS qv, list_distinct({tokens_sql("text")}) AS lexemes
           FROM embeddings LEFT JOIN benchmark ON item_id * 20 = vec_id WHERE vec_id % 20 = 0),
s0 AS (SELECT query_id, vec_id AS id, round(list_cosine_distance(embedding::DOUBLE[], qv::DOUBLE[]), 9) AS distance FROM embeddings, q),
sem AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS semantic_rank FROM s0 QUALIFY semantic_rank <= 20),
p AS (SELECT doc_id AS id, unnest({tokens_sql("string_split(text, chr(10))[1]")}) AS lexeme, 1 AS head FROM documents
      UNION ALL SELECT doc_id, unnest({tokens_sql("text")}), 0 FROM documents),
g AS (SELECT id, lexeme, sum(head) AS a, sum(1 - head) AS b FROM p GROUP BY ALL),
u AS (SELECT query_id, unnest(lexemes) AS lexeme FROM q),
k0 AS (SELECT query_id, id, round(sum(a)::DOUBLE * 1.0::DOUBLE + sum(b)::DOUBLE * 0.4::DOUBLE, 6) AS score FROM u JOIN g USING (lexeme) GROUP BY ALL),
kw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS keyword_rank FROM k0 QUALIFY keyword_rank <= 20),
fused AS (SELECT query_id, id, semantic_rank, keyword_rank, round(coalesce(1.0::DOUBLE / (60 + semantic_rank), 0) + coalesce(1.0::DOUBLE / (60 + keyword_rank), 0), 9) AS rrf_score
          FROM sem FULL JOIN kw USING (query_id, id)),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, id) AS position FROM fused QUALIFY position <= 5),
dated AS (SELECT doc_id AS id, DATE '2026-01-01' + (doc_id % 5)::INT AS day FROM labels WHERE quality = 0),
days AS (SELECT DISTINCT query_id, day FROM top JOIN dated USING (id)),
c0 AS (SELECT query_id, d.id, day, round(list_cosine_distance(embedding::DOUBLE[], qv::DOUBLE[]), 9) AS distance
       FROM dated d JOIN days USING (day) JOIN embeddings ON vec_id = d.id JOIN q USING (query_id) WHERE NOT EXISTS (FROM top t WHERE t.query_id = days.query_id AND t.id = d.id)),
comp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS position FROM c0 QUALIFY position <= 2)
"""


@query(FUSED_SQL + "SELECT query_id, position::BIGINT AS position, id, rrf_score, semantic_rank::BIGINT AS semantic_rank, keyword_rank::BIGINT AS keyword_rank, source FROM top LEFT JOIN documents ON doc_id = id")
def hybrid_rrf_topk(spark, sf_dir):
    top = search.best(fused(spark, sf_dir))
    late = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    return top.join(late, "id", "left").select("query_id", F.col("position").cast("long").alias("position"), "id", "rrf_score", F.col("semantic_rank").cast("long").alias("semantic_rank"), F.col("keyword_rank").cast("long").alias("keyword_rank"), "source")


@query(FUSED_SQL + """SELECT query_id, 0::BIGINT AS group_order, position::BIGINT AS position, id, rrf_score, 'fusion' AS retrieved_by FROM top
UNION ALL SELECT c.query_id, 1, c.position, c.id, coalesce(f.rrf_score, 0), 'dated_companion' FROM comp c LEFT JOIN fused f USING (query_id, id)""")
def hybrid_rrf_companions(spark, sf_dir):
    f = fused(spark, sf_dir)
    top = search.best(f)
    more = search.companions(top, dates(spark, sf_dir), vectors(spark, sf_dir), questions(spark, sf_dir).select("query_id", "embedding"))
    more = more.join(f.select("query_id", "id", "rrf_score"), ["query_id", "id"], "left")
    out = lambda df, order, name: df.select("query_id", F.lit(order).cast("long").alias("group_order"), F.col("position").cast("long").alias("position"), "id", F.coalesce("rrf_score", F.lit(0.0)).alias("rrf_score"), F.lit(name).alias("retrieved_by"))
    return out(top, 0, "fusion").unionByName(out(more, 1, "dated_companion")).orderBy("query_id", "group_order", "position")


@query(FUSED_SQL + """, n AS (SELECT query_id, count(*) AS companions FROM comp GROUP BY query_id) SELECT query_id, count(*) FILTER (WHERE semantic_rank IS NOT NULL AND keyword_rank IS NULL)::BIGINT AS semantic_only, count(*) FILTER (WHERE semantic_rank IS NULL)::BIGINT AS keyword_only,
count(*) FILTER (WHERE semantic_rank IS NOT NULL AND keyword_rank IS NOT NULL)::BIGINT AS both_arms, coalesce(max(companions), 0)::BIGINT AS companions FROM top LEFT JOIN n USING (query_id) GROUP BY query_id""")
def retrieval_arm_counts(spark, sf_dir):
    s, k = F.col("semantic_rank").isNotNull(), F.col("keyword_rank").isNotNull()
    top = search.best(fused(spark, sf_dir))
    more = search.companions(top, dates(spark, sf_dir), vectors(spark, sf_dir), questions(spark, sf_dir).select("query_id", "embedding")).groupBy("query_id").agg(F.count("*").alias("companions"))
    counts = top.groupBy("query_id").agg(F.count_if(s & ~k).alias("semantic_only"), F.count_if(~s).alias("keyword_only"), F.count_if(s & k).alias("both_arms"))
    return counts.join(more, "query_id", "left").withColumn("companions", F.coalesce("companions", F.lit(0)))


@query(FUSED_SQL + "SELECT query_id, id, score, keyword_rank::BIGINT AS keyword_rank FROM kw")
def keyword_rank_simple(spark, sf_dir):
    return keywords(spark, sf_dir).select("query_id", "id", "score", F.col("rank").cast("long").alias("keyword_rank"))


@query()
def porter_keyword_rank(spark, sf_dir):
    """The same by typed tokens and stems."""
    return keywords(spark, sf_dir, "english")


@query(FUSED_SQL + "SELECT query_id, id, score, keyword_rank::BIGINT AS keyword_rank FROM kw")
def keyword_rank_batch(spark, sf_dir):
    """The same without an index, for texts that are asked only once."""
    found = search.keyword_rank(stores.chunks(spark, sf_dir), questions(spark, sf_dir).select("query_id", "text"))
    return found.select("query_id", "id", "score", F.col("rank").cast("long").alias("keyword_rank"))


REPLACED_SQL = FUSED_SQL[: FUSED_SQL.index("s0 AS")].rstrip().rstrip(",") + f""",
docs AS (SELECT doc_id, text AS heading, CASE WHEN source IN ('src3', 'src11') THEN text || ' ' || text ELSE text END AS content FROM documents WHERE coalesce(source, '') NOT IN ('src3', 'src11') OR doc_id % 2 = 0),
p AS (SELECT doc_id AS id, unnest({tokens_sql("string_split(heading, chr(10))[1]")}) AS lexeme, 1 AS head FROM docs UNION ALL SELECT doc_id, unnest({tokens_sql("content")}), 0 FROM docs),
g AS (SELECT id, lexeme, sum(head) AS a, sum(1 - head) AS b FROM p GROUP BY ALL),
u AS (SELECT query_id, unnest(lexemes) AS lexeme FROM q),
k0 AS (SELECT query_id, id, round(sum(a)::DOUBLE * 1.0::DOUBLE + sum(b)::DOUBLE * 0.4::DOUBLE, 6) AS score FROM u JOIN g USING (lexeme) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::BIGINT AS keyword_rank FROM k0 QUALIFY keyword_rank <= 20"""


def _replaced(spark, sf_dir, number):
    root = stores.replaced_texts(spark, sf_dir)
    found = text_index.rank(spark, root, questions(spark, sf_dir).select("query_id", "text"), number=number)
    return found.select("query_id", "id", "score", F.col("rank").cast("long").alias("keyword_rank"))


@query(REPLACED_SQL)
def keyword_rank_replaced(spark, sf_dir):
    """After the rows of two sources were replaced: a segment and a list of void sources."""
    return _replaced(spark, sf_dir, 2)


@query(REPLACED_SQL)
def keyword_rank_merged(spark, sf_dir):
    """The same after all segments were merged."""
    return _replaced(spark, sf_dir, 3)


@query(FUSED_SQL + "SELECT query_id, id, distance, semantic_rank::BIGINT AS semantic_rank FROM sem")
def vector_index_topk(spark, sf_dir):
    """The semantic arm from the stored vector index."""
    found = vector_index.Index(spark, stores.vectors_of(spark, sf_dir), 1).nearest(questions(spark, sf_dir).select("query_id", "embedding"))
    return found.select("query_id", "id", "distance", F.col("rank").cast("long").alias("semantic_rank"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0),
v AS (SELECT vec_id AS id, CASE WHEN vec_id % 10 = 4 THEN list_transform(embedding::DOUBLE[], lambda x: -x) ELSE embedding::DOUBLE[] END AS e FROM embeddings WHERE vec_id % 20 <> 14),
s AS (SELECT query_id, id, round(list_cosine_distance(e, qv::DOUBLE[]), 9) AS distance FROM v, q)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::BIGINT AS semantic_rank FROM s QUALIFY semantic_rank <= 20""")
def vector_index_replaced(spark, sf_dir):
    """After the vectors of a source were replaced."""
    found = vector_index.Index(spark, stores.replaced_vectors(spark, sf_dir), 2).nearest(questions(spark, sf_dir).select("query_id", "embedding"))
    return found.select("query_id", "id", "distance", F.col("rank").cast("long").alias("semantic_rank"))


@query(FUSED_SQL + """, d AS (SELECT q.query_id, min(round(list_cosine_distance(e.embedding::DOUBLE[], qv::DOUBLE[]), 6)) AS nearest, count(t.id) AS n FROM q LEFT JOIN top t ON t.query_id = q.query_id AND t.id <> q.query_id LEFT JOIN embeddings e ON e.vec_id = t.id GROUP BY q.query_id)
SELECT query_id, nearest, n = 0 OR coalesce(nearest > 0.5, false) AS no_answer FROM d""")
def no_answer_gate(spark, sf_dir):
    """The nearest of the fused rows, the question's own not among them; rows without a vector have no distance."""
    q = questions(spark, sf_dir).select("query_id", F.col("embedding").alias("q"))
    top = search.best(fused(spark, sf_dir)).where("id <> query_id").select("query_id", "id").join(vectors(spark, sf_dir), "id", "left")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda x, y: x + y)
    far = F.round(1 - dot("embedding", "q") / F.sqrt(dot("embedding", "embedding") * dot("q", "q")), 6)
    near = q.join(top, "query_id", "left").groupBy("query_id").agg(F.min(far).alias("nearest"), F.count("id").alias("n"))
    return near.select("query_id", "nearest", ((F.col("n") == 0) | F.coalesce(F.col("nearest") > 0.5, F.lit(False))).alias("no_answer"))


@query(FUSED_SQL + """, gs AS (SELECT query_id, list(DISTINCT source) AS urls FROM q JOIN documents ON doc_id BETWEEN query_id + 1 AND query_id + 2 GROUP BY query_id),
hs AS (SELECT gs.query_id, bool_or(coalesce(list_contains(urls, source), false)) AS hit FROM gs LEFT JOIN top USING (query_id) LEFT JOIN documents ON doc_id = id GROUP BY gs.query_id)
SELECT count(*)::BIGINT AS questions, count(*) FILTER (WHERE hit)::BIGINT AS hits, count(*) FILTER (WHERE hit)::DOUBLE / nullif(count(*), 0) AS hit_rate FROM hs""")
def golden_hit_rate(spark, sf_dir):
    """Golden sources of a question are those of the two documents after its own."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    golden = questions(spark, sf_dir).select("query_id", F.explode(F.array(F.col("query_id") + 1, F.col("query_id") + 2)).alias("doc_id")).join(docs, "doc_id").select("query_id", "source").distinct()
    found = search.best(fused(spark, sf_dir)).join(docs.withColumnRenamed("doc_id", "id"), "id").select("query_id", "source").distinct().withColumn("hit", F.lit(True))
    hits = golden.join(found, ["query_id", "source"], "left").groupBy("query_id").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("hit"))
    return hits.agg(F.count("*").alias("questions"), F.count_if("hit").alias("hits"), evals.rate(F.count_if("hit"), F.count("*")).alias("hit_rate"))


@query(FUSED_SQL + ", x AS (SELECT * FROM s0 WHERE id % 20 <> 0 AND id % 3 = query_id % 3 AND id % 4 = 1) SELECT query_id, arg_min(id, struct_pack(d := distance, i := id)) AS cached_id, min(distance) AS distance, min(distance) <= 0.15 AS hit FROM x GROUP BY query_id")
def semantic_cache_lookup(spark, sf_dir):
    """Nearest cached answer of the question's own class and of the corpus's version; equal only within a distance of 0.15. The
    class is an id modulo 3, the version an id modulo 4."""
    cache = vectors(spark, sf_dir).where("id % 20 <> 0 and id % 4 = 1").withColumn("kind", F.expr("id % 3"))
    near = search.nearest(cache, questions(spark, sf_dir).select("query_id", "embedding", F.expr("query_id % 3").alias("kind")), 1, "kind")
    return near.select("query_id", F.col("id").alias("cached_id"), "distance", (F.col("distance") <= 0.15).alias("hit"))


@query("SELECT round(min(d), 6) AS least, round(avg(d), 6) AS mean, round(max(d), 6) AS most, count(*)::BIGINT AS pairs FROM (SELECT list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE a.vec_id % 20 = 0 AND b.vec_id % 20 = 0)")
def pairwise_question_distance(spark, sf_dir):
    out = search.pair_distances(questions(spark, sf_dir).select("query_id", "embedding"))
    return out.select(*(F.round(c, 6).alias(c) for c in ("least", "mean", "most")), "pairs")


@query("SELECT coalesce(strftime(max(ts), '%Y-%m-%d'), 'none') || ':' || count(*)::VARCHAR || ':' || sum((event_type = 'purchase')::INT)::VARCHAR AS version FROM events")
def corpus_version(spark, sf_dir):
    day = F.coalesce(F.date_format(F.max("ts"), "yyyy-MM-dd"), F.lit("none"))
    return table(spark, sf_dir, "events").agg(F.concat_ws(":", day, F.count("*").cast("string"), F.count_if(F.col("event_type") == "purchase").cast("string")).alias("version"))


# Citations and text of answers. Answers are what assistants say, with citations put after them.

ANSWERS_SQL = "WITH a AS (SELECT conv_id, turn, text || ' See [' || (turn + 1)::VARCHAR || ', ' || (conv_id % 7)::VARCHAR || '] and [' || (conv_id % 3)::VARCHAR || '] or 【' || (conv_id % 5)::VARCHAR || '†page】.' AS t, (conv_id % 4)::BIGINT AS n FROM conversations WHERE role = 'assistant'), c AS (SELECT *, list_sort(list_distinct(flatten(list_transform(regexp_extract_all(t, '\\[(\\d+(?:\\s*,\\s*\\d+)*)\\]', 1), lambda s: list_transform(string_split(s, ','), lambda x: trim(x)::INT))))) AS i FROM a) ".replace("\\\\", "\\")


def answers(spark, sf_dir):
    s = lambda c: F.expr(c).cast("string")
    t = F.concat("text", F.lit(" See ["), s("turn + 1"), F.lit(", "), s("conv_id % 7"), F.lit("] and ["), s("conv_id % 3"), F.lit("] or 【"), s("conv_id % 5"), F.lit("†page】."))
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", t.alias("t"), F.expr("conv_id % 4").alias("n"))


@query(ANSWERS_SQL + "SELECT conv_id, turn, array_to_string(i, ',') AS cited FROM c")
def citation_parse(spark, sf_dir):
    return answers(spark, sf_dir).select("conv_id", "turn", joined(tx.cited(F.col("t"))).alias("cited"))


@query(ANSWERS_SQL + "SELECT conv_id, turn, CASE WHEN len(list_filter(k, lambda x: x < 1 OR x > n)) > 0 THEN 'citation_index_out_of_range' WHEN conv_id % 3 > 0 AND len(k) = 0 THEN 'answer_missing_citation' END AS reason FROM (SELECT *, CASE WHEN turn % 4 = 1 THEN []::INT[] ELSE list_filter(i, lambda x: x > 0 AND x < 4) END AS k FROM c)")
def citation_verify(spark, sf_dir):
    found = F.when(F.expr("turn % 4 = 1"), F.array().cast("array<int>")).otherwise(F.filter(tx.cited(F.col("t")), lambda i: (i > 0) & (i < 4)))
    kind = F.when(F.expr("conv_id % 3 > 0"), "answer").otherwise("refusal_advice")
    return answers(spark, sf_dir).select("conv_id", "turn", tx.citation_reason(found, F.col("n"), kind).alias("reason"))


@query(ANSWERS_SQL + r"""SELECT conv_id, turn, len(p)::BIGINT AS segments, len(list_filter(p, lambda x: regexp_full_match(x, '\[(\d+(?:\s*,\s*\d+)*)\]')))::BIGINT AS citations, md5(array_to_string(p, '')) AS whole
FROM (SELECT conv_id, turn, list_filter(string_split(regexp_replace(t, '(\[\d+(?:\s*,\s*\d+)*\])', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS p FROM a)""")
def answer_segments(spark, sf_dir):
    p = tx.segments(F.col("t"))
    return answers(spark, sf_dir).select("conv_id", "turn", F.size(p).cast("long").alias("segments"), F.size(F.filter(p, lambda x: x["cites"])).cast("long").alias("citations"), md5(F.array_join(F.transform(p, lambda x: x["value"]), "")).alias("whole"))


@query(ANSWERS_SQL + "SELECT conv_id, turn, len(list_filter(i, lambda x: x < 1 OR x > n))::BIGINT AS hallucinated, greatest(0, n - len(list_filter(i, lambda x: x >= 1 AND x <= n)))::BIGINT AS unreferenced FROM c")
def citation_analyze(spark, sf_dir):
    i = tx.cited(F.col("t"))
    return answers(spark, sf_dir).select("conv_id", "turn", tx.hallucinated(i, F.col("n")).alias("hallucinated"), tx.unreferenced(i, F.col("n")).alias("unreferenced"))


@query(ANSWERS_SQL + r"SELECT conv_id, turn, md5(regexp_replace(t, '【\s*(\d+)\s*(?:†[^】]*)?】', '[\1]', 'g')) AS folded FROM a")
def native_markup_fold(spark, sf_dir):
    return answers(spark, sf_dir).select("conv_id", "turn", F.md5(tx.fold_markup(F.col("t")).cast("binary")).alias("folded"))


@query(ANSWERS_SQL + f"SELECT conv_id, turn, md5(CASE WHEN regexp_matches(x, '{tx.SOURCE_LIST}') THEN regexp_replace(regexp_replace(x, '{tx.SOURCE_LIST}[\\s\\S]*$', ''), '\\s+$', '') ELSE x END) AS stripped FROM (SELECT *, CASE WHEN conv_id % 2 = 0 THEN t || chr(10) || ' **Source URLs**: ' || chr(10) || '1. x' ELSE t END AS x FROM a)")
def source_list_strip(spark, sf_dir):
    x = F.when(F.expr("conv_id % 2 = 0"), F.concat("t", F.lit("\n **Source URLs**: \n1. x"))).otherwise(F.col("t"))
    return answers(spark, sf_dir).select("conv_id", "turn", md5(tx.strip_sources(x)).alias("stripped"))


REDACTED_SQL = r"""WITH d AS (SELECT doc_id, text || ' 078-05-1120, A12345678 and A-1234567' AS t FROM documents),
e AS (SELECT doc_id, regexp_replace(t, '(?i)[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}', '[redacted-email]', 'g') AS t FROM d),
n AS (SELECT doc_id, regexp_replace(t, '(?i)\bA[- ]?\d{7,9}\b', '[redacted-a-number]', 'g') AS t FROM e),
s AS (SELECT doc_id, regexp_replace(t, '\b\d{3}-\d{2}-\d{4}\b', '[redacted-ssn]', 'g') AS t FROM n),
p AS (SELECT doc_id, regexp_replace(t, '\+?\d{0,3}[-. ]?\(?\d{3}\)?[-. ]?\d{3}[-. ]?\d{4}\b', '[redacted-phone]', 'g') AS t FROM s)"""


@query(REDACTED_SQL + r" SELECT doc_id, md5(t) AS redacted, len(regexp_extract_all(t, '\[redacted-[a-z-]+\]'))::BIGINT AS n FROM p")
def pii_redact(spark, sf_dir):
    t = tx.redact(F.concat("text", F.lit(" 078-05-1120, A12345678 and A-1234567")))
    rows = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return rows.select("doc_id", F.md5(F.col("t").cast("binary")).alias("redacted"), F.regexp_count("t", F.lit(r"\[redacted-[a-z-]+\]")).cast("long").alias("n"))


@query(REDACTED_SQL.replace("' 078-05-1120, A12345678 and A-1234567'", "' 078-05-1120'") + """, l AS (SELECT doc_id, lang FROM documents)
SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN md5(t) END AS question, CASE WHEN doc_id % 5 > 0 THEN doc_id END AS id, CASE WHEN doc_id % 5 > 0 THEN lang END AS lang, CASE WHEN doc_id % 5 = 0 THEN md5(text) END AS body FROM p JOIN l USING (doc_id) JOIN documents USING (doc_id, lang)""")
def json_field_redact(spark, sf_dir):
    """Of every fifth row the body is a text, and no JSON."""
    body = F.to_json(F.struct(F.col("doc_id").alias("id"), F.concat("text", F.lit(" 078-05-1120")).alias("question"), F.col("lang")))
    rows = table(spark, sf_dir, "documents").select("doc_id", tx.redact_question(F.when(F.expr("doc_id % 5 = 0"), F.col("text")).otherwise(body)).alias("body"))
    is_json = F.expr("doc_id % 5 > 0")
    field = lambda name, kind: F.when(is_json, F.try_variant_get(F.try_parse_json("body"), f"$.{name}", kind))
    return rows.select("doc_id", md5(field("question", "string")).alias("question"), field("id", "long").alias("id"), field("lang", "string").alias("lang"), F.when(~is_json, md5(F.col("body"))).alias("body"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN sha256(doc_id::VARCHAR) ELSE " + "{}" + " END AS session FROM documents")
def session_header(spark, sf_dir):
    """Every second request bears a session of its own, every third of the others a name that is none."""
    header = F.when(F.expr("doc_id % 2 = 0"), F.sha2(F.col("doc_id").cast("string").cast("binary"), 256)).when(F.expr("doc_id % 3 = 0"), "not a session")
    return table(spark, sf_dir, "documents").select("doc_id", tx.session_or_hash(header, F.col("source"), "session-secret").alias("session"))


def _hmac_sql(value: str, secret: str) -> str:
    i, o = ("".join(f"\\x{b ^ p:02X}" for b in secret.encode().ljust(64, b"\0")) for p in (0x36, 0x5C))
    return f"sha256('{o}'::BLOB || unhex(sha256('{i}'::BLOB || encode({value}))))"


ORACLE_SQL["session_header"] = ORACLE_SQL["session_header"].format(_hmac_sql("source", "session-secret"))


@query(f"SELECT user_id, {_hmac_sql('user_id::VARCHAR', 'session-secret')} AS session, count(*)::BIGINT AS n, min(ts) AS first_seen FROM events GROUP BY user_id")
def session_hmac(spark, sf_dir):
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"))
    return users.select("user_id", tx.session_hash(F.col("user_id").cast("string"), "session-secret").alias("session"), "n", "first_seen")


@query("SELECT conv_id, turn, left(sha256(text), 12) AS version, length(text) BETWEEN 1 AND 4000 AS chars_ok, strlen(text) <= 32000 AS bytes_ok FROM conversations")
def length_gate(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.left(F.sha2("text", 256), F.lit(12)).alias("version"), F.length("text").between(1, 4000).alias("chars_ok"), (F.octet_length("text") <= 32000).alias("bytes_ok"))


ADVICE_SQL = " OR ".join(f"contains(q, '{p}')" for p in tx.ADVICE)


#: What a second classifier replied to every third question.
REPLIES = {0: 'so: {"advice": true}', 1: '{"advice": false} ', 2: '{"advice": "true"}', 3: "no idea", 4: "{broken", 5: '{"advice": {"a": 1}}'}
REPLY_SQL = "CASE WHEN (conv_id + turn) % 3 = 0 THEN CASE conv_id % 6 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in REPLIES.items()) + " END END"


@query(f"WITH c AS (SELECT conv_id, turn, lower(CASE conv_id % 5 WHEN 0 THEN 'Should I ' ELSE '' END || text) AS q, CASE WHEN (conv_id + turn) % 3 = 0 THEN CASE conv_id % 6 WHEN 0 THEN true WHEN 1 THEN false END END AS verdict FROM conversations WHERE role = 'user') SELECT conv_id, turn, verdict, {ADVICE_SQL} OR coalesce(verdict, false) AS advice, CASE WHEN {ADVICE_SQL} THEN 'rule' WHEN verdict IS NOT NULL THEN 'model' ELSE 'model_unavailable' END AS decided_by FROM c")
def advice_rule_gate(spark, sf_dir):
    """A rule decides first; a model's reply may only turn what it left open into advice."""
    q = F.concat(F.when(F.expr("conv_id % 5 = 0"), "Should I ").otherwise(""), "text")
    advice, verdict = tx.asks_advice(q), tx.advice_verdict(F.expr(REPLY_SQL))
    decided = F.when(advice, "rule").when(F.col("verdict").isNotNull(), "model").otherwise("model_unavailable")
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("verdict", verdict)
    return rows.select("conv_id", "turn", "verdict", (advice | F.coalesce("verdict", F.lit(False))).alias("advice"), decided.alias("decided_by"))


@query(f"WITH d AS (SELECT doc_id, 'In [1] form I-20 of Sept. 5, 2026 costs 1,200 or 60 (see http://x.org/77), 01/30/2026, 1999, H-1B [2, 3] ' || (doc_id % 97)::VARCHAR || '. ' || text AS t FROM documents) SELECT doc_id, array_to_string({figures_sql('t')}, ',') AS figures FROM d")
def figure_extract(spark, sf_dir):
    t = F.concat(F.lit("In [1] form I-20 of Sept. 5, 2026 costs 1,200 or 60 (see http://x.org/77), 01/30/2026, 1999, H-1B [2, 3] "), F.expr("cast(doc_id % 97 as string)"), F.lit(". "), "text")
    return table(spark, sf_dir, "documents").select("doc_id", joined(tx.figures(t)).alias("figures"))


@query(f"WITH d AS (SELECT doc_id, {parts_sql("text || ' From Sept. 5 on. In Dec. it ends. ' || text")} AS p FROM documents) SELECT doc_id, len(p)::BIGINT AS sentences, md5(array_to_string(p, '|')) AS parts FROM d")
def sentence_split(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", tx.sentence_parts(F.concat("text", F.lit(" From Sept. 5 on. In Dec. it ends. "), "text")).alias("p"))
    marked = F.transform("p", lambda x: F.concat(x["sentence"], F.when(F.length(x["separator"]) > 0, F.concat(F.lit("\u0001"), x["separator"])).otherwise("")))
    return rows.select("doc_id", F.size("p").cast("long").alias("sentences"), md5(F.array_join(marked, "|")).alias("parts"))


@query(r"SELECT doc_id, CASE WHEN length(f) <= 240 THEN f ELSE regexp_replace(left(f, 240), '\s\S*$', '') || '...' END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM documents)")
def snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


@query(r"SELECT doc_id, len(list_filter(list_transform(string_split_regex(replace(text, chr(10), chr(10) || ' ' || chr(10)), '\n\s*\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: length(p) > 0))::BIGINT AS paragraphs FROM documents")
def paragraph_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tx.paragraphs(F.replace("text", F.lit("\n"), F.lit("\n \n")))).cast("long").alias("paragraphs"))


PARAGRAPHS_SQL = r"list_filter(list_transform(string_split_regex(replace(text, chr(10), chr(10) || ' ' || chr(10)), '\n\s*\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: length(p) > 0)"


@query(f"SELECT doc_id, CASE WHEN length(f) BETWEEN 1 AND 90 AND (len(p) > 1 OR length(p[1]) > length(f)) THEN f END AS lead FROM (SELECT doc_id, p, regexp_extract(coalesce(p[1], ''), '^[\\s\\S]*?[.!?](?:\\s|$)') AS g, CASE WHEN regexp_matches(g, '\\s$') THEN left(g, length(g) - 1) ELSE g END AS f FROM (SELECT doc_id, {PARAGRAPHS_SQL} AS p FROM documents))")
def lead_sentence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.lead(F.replace("text", F.lit("\n"), F.lit("\n \n"))).alias("lead"))


@query(f"""WITH t AS (SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'One of the sources above describes a rule that is not in force. See x.' ELSE '' END AS text FROM documents), a AS (SELECT doc_id, {PARAGRAPHS_SQL} AS p FROM t)
SELECT doc_id, len(CASE WHEN regexp_matches(p[len(p)], '^(?:One|Some) of the sources above describes? a rule that ') THEN p[1 : len(p) - 1] ELSE p END)::BIGINT AS paragraphs FROM a""")
def notice_paragraph_drop(spark, sf_dir):
    """Every second text repeats a notice as its last paragraph, which goes."""
    more = F.when(F.expr("doc_id % 2 = 0"), "\n\nOne of the sources above describes a rule that is not in force. See x.").otherwise("")
    text = F.concat(F.replace("text", F.lit("\n"), F.lit("\n \n")), more)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tx.without_notice(tx.paragraphs(text))).cast("long").alias("paragraphs"))


@query(r"SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '^www\.', '') AS host, regexp_replace(regexp_replace(lower(regexp_extract(url, '([^/?#]+)/*(?:[?#].*)?$', 1)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
def hostname(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.hostname(F.col("url")).alias("host"), tx.slug(F.col("url")).alias("slug"))


@query(r"""WITH u AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '([^/]+)/*$', 1) AS last FROM pages)
SELECT page_id, CASE WHEN last <> '' THEN host || '/' || last ELSE host END AS label, string_split(regexp_replace(lower(host), '^www\.', ''), '.')[1] AS hint,
 'topic-' || string_split(regexp_replace(lower(host), '^www\.', ''), '.')[1] || '-' || regexp_replace(regexp_replace(lower(coalesce(nullif(last, ''), host)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '.md' AS snapshot FROM u""")
def source_labels(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", tx.source_label(u).alias("label"), tx.domain_hint(u).alias("hint"), tx.snapshot_name(F.lit("topic"), u).alias("snapshot"))


HYPHENS = "'E-Verify of I-20a, H-1B and xi-12345; '"


@query(rf"SELECT doc_id, md5(regexp_replace(regexp_replace({HYPHENS} || text, '(?i)\b(E)-(Verify)\b', '\1‑\2', 'g'), '\b([A-Za-z]{{1,3}})-(\d{{1,4}}[A-Za-z]?)\b', '\1‑\2', 'g')) AS t FROM documents")
def nb_hyphen(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", md5(tx.plain_hyphens(F.concat(F.expr(HYPHENS), "text"))).alias("t"))


# Pages.

STAMP = "CASE page_id % 5 WHEN 0 THEN ' Last Reviewed/Updated: 01/30/2026' WHEN 1 THEN ' Last updated: Sept. 5, 2026' WHEN 2 THEN ' Updated 3/4/2025' WHEN 3 THEN ' Last Reviewed/Updated: 13/45/2026' ELSE '' END"
DAY_SQL = "CASE page_id % 5 WHEN 0 THEN DATE '2026-01-30' WHEN 1 THEN DATE '2026-09-05' WHEN 2 THEN DATE '2025-03-04' END"


@query(rf"SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, {DAY_SQL} AS day, md5(regexp_replace(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM pages")
def html_text(spark, sf_dir):
    """Each page says in its own way, after all that it has, when it was last changed, or doesn't."""
    page, body = F.concat("html", F.expr(STAMP)), ht.page_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", ht.title(F.col("html")).alias("title"), ht.last_updated(ht.page_text(page)).alias("day"), md5(body).alias("body"))


@query()
def html_to_markdown(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", ht.to_markdown("html").alias("markdown"))


# Bookkeeping. Sources are users of events; an error is a failed check, a view one that robots refuse.


def checks(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), "ts", "event_id", "event_type")


@query("""WITH e AS (SELECT *, sum(CASE WHEN event_type NOT IN ('error', 'view') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch FROM events)
SELECT user_id AS source_id, event_id, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, epoch ORDER BY ts, event_id)::BIGINT AS consecutive_failures FROM e""")
def consecutive_failures(spark, sf_dir):
    out = ledger.failure_counts(checks(spark, sf_dir), "source_id", ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "view")
    return out.select("source_id", "event_id", F.col("consecutive_failures").cast("long").alias("consecutive_failures"))


@query("""WITH e AS (SELECT *, sum(CASE WHEN event_type NOT IN ('error', 'view') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch FROM events),
f AS (SELECT user_id, event_type, ts, event_id, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, epoch ORDER BY ts, event_id) AS n FROM e),
s AS (SELECT user_id, arg_max(n, struct_pack(ts, event_id)) AS n, arg_max(event_type, struct_pack(ts, event_id)) AS last, max(ts) FILTER (WHERE event_type NOT IN ('error', 'view')) AS ok FROM f GROUP BY user_id),
a AS (SELECT *, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ok)) / 3.6e9::DOUBLE AS h FROM s)
SELECT user_id AS source_id, n::BIGINT AS failures, CASE WHEN h IS NULL THEN 'unknown' WHEN h <= 24 THEN 'current' WHEN h <= 168 THEN 'recent' ELSE 'stale' END AS band, CASE WHEN last = 'view' OR n >= 3 OR h IS NULL OR h > 168 THEN 'broken' ELSE 'ok' END AS health FROM a""")
def source_health(spark, sf_dir):
    out = ledger.failure_counts(checks(spark, sf_dir), "source_id", ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "view")
    last = out.groupBy("source_id").agg(F.max(F.struct("ts", "event_id", "consecutive_failures", "event_type")).alias("x"), F.max(F.when(~F.col("event_type").isin("error", "view"), F.col("ts"))).alias("ok"))
    age = ledger.age_hours(F.lit("2024-02-01 00:00:00").cast("timestamp"), F.col("ok"))
    error = F.when(F.col("x.event_type") == "view", "robots_disallowed").otherwise("none")
    return last.select("source_id", F.col("x.consecutive_failures").cast("long").alias("failures"), ledger.freshness(age).alias("band"), ledger.health(F.col("x.consecutive_failures"), error, age).alias("health"))


@query("SELECT count(DISTINCT user_id)::BIGINT AS sources, min(ts) AS oldest, max(ts) AS newest, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-29')::BIGINT AS older FROM events")
def sources_status(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.countDistinct("user_id").alias("sources"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"), F.count_if(F.col("ts") < F.expr("timestamp_ntz '2024-01-29 00:00:00'")).alias("older"))


@query("""WITH d AS (SELECT unnest(generate_series(min(ts)::DATE, max(ts)::DATE + 2, INTERVAL 1 day))::DATE AS day FROM events), c AS (SELECT ts::DATE AS day, count(*) AS n FROM events WHERE event_type = 'purchase' AND extract(day FROM ts) % 3 > 0 GROUP BY 1)
SELECT day, coalesce(n, 0)::BIGINT AS calls, coalesce(n, 0) >= 50 AS capped, false AS capped_off FROM d LEFT JOIN c USING (day)""")
def daily_generation(spark, sf_dir):
    """Calls of each day, also of days without any; a cap of nought or less is off. Every third day has no calls here."""
    events = table(spark, sf_dir, "events")
    days = events.agg(F.to_date(F.min("ts")).alias("a"), F.date_add(F.to_date(F.max("ts")), 2).alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    calls = events.where("event_type = 'purchase' and day(ts) % 3 > 0").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    capped = lambda cap: (n >= cap) & F.lit(cap > 0)
    return days.join(calls, "day", "left").select("day", n.alias("calls"), capped(50).alias("capped"), capped(0).alias("capped_off"))


@query("SELECT event_id, n > 40 AS over_budget FROM (SELECT event_id, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'purchase')")
def budget_gate(spark, sf_dir):
    """The first 40 calls of a day are kept for each task and then for the day; the last of them tells of all others."""
    calls = table(spark, sf_dir, "events").where("event_type = 'purchase'").withColumn("day", F.to_date("ts"))
    at = F.struct("ts", "event_id")
    first = calls.withColumn("n", F.row_number().over(W.partitionBy("day").orderBy("ts", "event_id"))).where("n <= 40")
    last = first.where("n = 40").select("day", at.alias("last"))
    return calls.join(last, "day", "left").select("event_id", F.coalesce(at > F.col("last"), F.lit(False)).alias("over_budget"))


@query("SELECT ts::DATE AS day, sum(value) FILTER (WHERE event_type = 'purchase') AS tokens, round(count(*) FILTER (WHERE event_type = 'error')::DOUBLE / nullif(count(*), 0), 9) AS failed, max(value) AS gauge FROM events GROUP BY 1")
def usage_by_day(spark, sf_dir):
    """Tokens, the share of requests that failed, and the highest gauge of each day."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum(F.when(kind == "purchase", F.col("value"))).alias("tokens"), F.round(evals.rate(F.count_if(kind == "error"), F.count("*")), 9).alias("failed"), F.max("value").alias("gauge"))


@query("SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def response_mix(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "6 hours")["start"].alias("start"), "event_type").agg(F.count("*").alias("n")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


BUCKET_SQL = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
b AS (SELECT user_id, i, event_id, t, 3.0::DOUBLE AS before FROM e WHERE i = 1
 UNION ALL SELECT e.user_id, e.i, e.event_id, e.t, least(3.0::DOUBLE, CASE WHEN b.before >= 1 THEN b.before - 1 ELSE b.before END + greatest(0.0::DOUBLE, (e.t - b.t)::DOUBLE / 1e6::DOUBLE) * (1.0::DOUBLE / 21600)) FROM b JOIN e ON e.user_id = b.user_id AND e.i = b.i + 1)
SELECT user_id, event_id, before >= 1 AS allowed, CASE WHEN before >= 1 THEN 0 ELSE floor((1 - before) / (1.0::DOUBLE / 21600)) + 1 END::BIGINT AS retry_after FROM b"""


@query(BUCKET_SQL)
def token_bucket(spark, sf_dir):
    """Three requests at once and one more every six hours, for each user."""
    return buckets.token_bucket(table(spark, sf_dir, "events"), "user_id", F.unix_micros(F.col("ts").cast("timestamp")), "event_id", 3.0, 1.0 / 21600)


def _halves(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("source_url"), "doc_id", F.col("n_chars").cast("long").alias("n"))
    return docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0")


@query("WITH o AS (FROM documents WHERE doc_id % 3 <> 0), n AS (FROM documents WHERE doc_id % 3 = 0 AND source < 'src5') SELECT source AS source_url, doc_id, n_chars::BIGINT AS n FROM o WHERE source NOT IN (SELECT source FROM n) UNION ALL SELECT source, doc_id, n_chars FROM n")
def replace_chunks(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    new = new.where("source_url < 'src5'")
    return ledger.replace_group(old, new, new, "source_url")


@query("WITH o AS (SELECT source AS source_url, max(n_chars) AS n FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1), n AS (SELECT source AS source_url, max(n_chars) AS n FROM documents WHERE doc_id % 3 = 0 AND source < 'src5' GROUP BY 1) SELECT source_url, coalesce(n.n, o.n)::BIGINT AS n FROM o FULL JOIN n USING (source_url)")
def upsert_sources(spark, sf_dir):
    old, new = (d.groupBy("source_url").agg(F.max("n").alias("n")) for d in _halves(spark, sf_dir))
    return ledger.upsert(old, new.where("source_url < 'src5'"), "source_url")


@query("SELECT source AS source_url, sum(n_chars)::BIGINT AS n FROM documents GROUP BY 1")
def increment_upsert(spark, sf_dir):
    old, new = (d.groupBy("source_url").agg(F.sum("n").alias("n")) for d in _halves(spark, sf_dir))
    return ledger.increment(old, new, "source_url", "n")


@query("WITH o AS (SELECT doc_id, n_chars::BIGINT AS n, source AS source_url FROM documents WHERE doc_id % 3 <> 0), w AS (SELECT doc_id, n_chars::BIGINT AS n, source AS source_url FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, n + 1, source_url FROM o) FROM o UNION ALL FROM w WHERE doc_id NOT IN (SELECT doc_id FROM o)")
def insert_if_absent(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    return ledger.insert_absent(old, new.unionByName(old.withColumn("n", F.col("n") + 1)), "doc_id")


@query("SELECT o_custkey, count(*)::BIGINT AS n, max(o_orderdate) AS newest FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1 OR (count(*) FILTER (WHERE o_orderpriority IS NULL) > 0 AND count(o_orderpriority) > 0)")
def consistency_having(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("newest"), F.countDistinct("o_orderstatus").alias("d"), F.count_if(F.col("o_orderpriority").isNull()).alias("nulls"), F.count("o_orderpriority").alias("some"))
    return g.where("d > 1 or (nulls > 0 and some > 0)").select("o_custkey", "n", "newest")


# Documents as Markdown: every third line is a heading of level 1 to 4, some of them emphasised or linked, and some lines are in fences.


def markdown(spark, sf_dir):
    own = lambda x: F.regexp_replace(x, "^\\s+|\\s+$", "")
    deep = lambda x: F.concat(F.repeat(F.lit("[** "), 9), own(x), F.repeat(F.lit(" **](#a)"), 9))
    title = lambda x, i: F.when(i % 12 == 0, deep(x)).when(i % 6 == 0, F.concat(F.lit("**"), own(x), F.lit("**"))).when(i % 15 == 3, F.concat(F.lit("[**"), own(x), F.lit("**](#a)"))).otherwise(own(x))
    line = lambda x, i: F.when(i % 3 == 0, F.concat(F.repeat(F.lit("#"), (i % 4 + 1).cast("int")), F.lit(" "), title(x, i))).when(i % 20 == 7, "```").when(i % 20 == 11, "  ```").otherwise(x)
    body = F.array_join(F.transform(F.split("text", "\n"), line), "\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.expr("doc_id % 10 = 0"), F.col("text")).otherwise(F.concat(F.lit("above\n"), body)).alias("body"))


MARKDOWN_SQL = r"""WITH RECURSIVE d0 AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents),
d1 AS (SELECT doc_id, text, list_transform(a, lambda x, n: CASE WHEN (n - 1) % 3 = 0 THEN repeat('#', ((n - 1) % 4 + 1)::INT) || ' ' || CASE WHEN (n - 1) % 12 = 0 THEN repeat('[** ', 9) || regexp_replace(x, '^\s+|\s+$', '', 'g') || repeat(' **](#a)', 9) WHEN (n - 1) % 6 = 0 THEN '**' || regexp_replace(x, '^\s+|\s+$', '', 'g') || '**' WHEN (n - 1) % 15 = 3 THEN '[**' || regexp_replace(x, '^\s+|\s+$', '', 'g') || '**](#a)' ELSE regexp_replace(x, '^\s+|\s+$', '', 'g') END
  WHEN (n - 1) % 20 = 7 THEN '```' WHEN (n - 1) % 20 = 11 THEN '  ```' ELSE x END) AS a FROM d0),
b AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN text ELSE 'above' || chr(10) || array_to_string(a, chr(10)) END AS body FROM d1),
l AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS x, unnest(range(0, len(string_split(body, chr(10))))) AS i FROM b),
e AS (SELECT *, regexp_matches(x, '^\s*(?:```|~~~)') AS fence FROM l),
f AS (SELECT *, sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY i) % 2 AS fenced FROM e),
raw AS (SELECT *, trim(regexp_extract(x, '^#{1,4}[ \t]+(\S.*?)\s*$', 1)) AS label FROM f),
peel AS (SELECT DISTINCT label, label AS bare, 0 AS layers FROM raw
         UNION ALL SELECT label, trim(regexp_replace(regexp_replace(bare, '^\*\*(.+)\*\*$|^__(.+)__$', '\1\2'), '^\[(.+)\]\([^)]*\)$', '\1')), layers + 1 FROM peel
         WHERE regexp_matches(bare, '^(\*\*.+\*\*|__.+__|\[.+\]\([^)]*\))$')),
bared AS (SELECT label, max_by(bare, layers) AS bare FROM peel GROUP BY label),
h AS (SELECT raw.*, CASE WHEN fenced = 0 AND NOT fence THEN nullif(bare, '') END AS name FROM raw JOIN bared USING (label)),
m AS (SELECT *, CASE WHEN name IS NOT NULL THEN length(regexp_extract(x, '^(#+)', 1)) END AS mark FROM h),
n AS (SELECT *, count(mark) OVER (PARTITION BY doc_id ORDER BY i) AS nth, count(mark) OVER (PARTITION BY doc_id) AS headings FROM m),
o AS (SELECT *, mark IS NOT NULL AND (nth = 1 OR mark > 1) AS opens FROM n WHERE nth > 0 OR headings = 0),
s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM o),
g AS (SELECT doc_id, section, min(i) AS line, CASE WHEN section <= 1 THEN 1 ELSE max(mark) FILTER (WHERE opens) END AS level, coalesce(max(name) FILTER (WHERE opens), 'Untitled') AS heading,
      regexp_replace(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT opens), ''), '^\s+|\s+$', '', 'g') AS chunk FROM s GROUP BY doc_id, section),
p AS (SELECT *, last_value(CASE WHEN chunk = '' AND section > 1 THEN heading END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent, first_value(heading) OVER (PARTITION BY doc_id ORDER BY section) AS title FROM g)
SELECT doc_id, line::BIGINT AS line, level::BIGINT AS level, heading, parent, concat_ws(' > ', title, parent, nullif(heading, title)) AS breadcrumb, md5(chunk) AS chunk FROM p WHERE chunk <> ''"""


@query(MARKDOWN_SQL)
def chunk_sections(spark, sf_dir):
    out = ledger.sections(markdown(spark, sf_dir), "doc_id", "body")
    return out.select("doc_id", F.col("line").cast("long").alias("line"), F.col("level").cast("long").alias("level"), "heading", "parent", "breadcrumb", md5(F.col("chunk")).alias("chunk"))


INGEST_SQL = MARKDOWN_SQL[: MARKDOWN_SQL.rindex("SELECT doc_id, line::BIGINT")] + """SELECT doc_id AS source_url, count(*)::BIGINT AS chunks, count(*)::BIGINT AS fresh, sum(length(concat_ws(' > ', title, parent, nullif(heading, title))) + 2 + length(chunk))::BIGINT AS chars,
 DATE '2026-09-14' AS fetched_at, (doc_id % 2 = 0)::BIGINT AS changes FROM p WHERE chunk <> '' GROUP BY doc_id
UNION ALL SELECT -1 - page_id, 1, 0, length(html), CASE WHEN page_id % 2 = 1 THEN DATE '2026-01-01' END, CASE WHEN page_id % 2 = 1 THEN 0 END FROM pages"""


@query(INGEST_SQL)
def ingest_snapshots(spark, sf_dir):
    """Every document's Markdown takes the place of the chunks that it had; sources of pages stay as they are."""
    bodies = markdown(spark, sf_dir).select(F.col("doc_id").alias("source_url"), "body")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_url"), F.lit("old").alias("content"))
    before = docs.unionByName(table(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("source_url"), F.col("html").alias("content")))
    kinds = list(zip(ingest.ANNOTATIONS, ("date", "string", "string", "boolean")))
    none = [F.lit(None).cast(t).alias(c) for c, t in kinds]
    old = before.select(F.col("source_url").alias("id"), "source_url", F.lit("old").alias("section_heading"), F.lit(1).alias("heading_level"), "content", F.array(F.lit(1.0)).alias("embedding"), *none)
    had = before.where("source_url % 2 = 0").select("source_url", F.lit("x").alias("last_indexed_body"), F.lit("2026-01-01").cast("date").alias("fetched_at"), F.lit(None).cast("date").alias("last_changed_at"), F.lit(0).alias("change_count"))
    sources, chunks = ingest.reindex(had, old, bodies, docs.select("source_url", *none), prose.embedder(8), F.lit("2026-09-14").cast("date"))
    per = chunks.groupBy("source_url").agg(F.count("*").alias("chunks"), F.count_if(F.col("section_heading") != "old").alias("fresh"), F.sum(F.length("content")).alias("chars"))
    return per.join(sources, "source_url", "left").select("source_url", "chunks", "fresh", "chars", F.col("fetched_at"), F.col("change_count").cast("long").alias("changes"))


# Changes: a document against itself reordered, in capitals, with a line more, or as it is, by its id.


def versions(spark, sf_dir):
    lines = tx.content_lines(F.col("text"))
    d = table(spark, sf_dir, "documents").select("doc_id", lines.alias("old"))
    new = F.when(F.expr("doc_id % 4 = 0"), F.col("old")).when(F.expr("doc_id % 4 = 1"), F.reverse("old")).when(F.expr("doc_id % 4 = 2"), F.transform("old", lambda x: F.concat(F.translate(x, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit("!")))).otherwise(F.concat(F.slice("old", 2, F.greatest(F.size("old") - 1, F.lit(0))), F.array(*map(F.lit, ["A line more of 60 days.", "You must file I-20 by Sept. 5, 2026 for $1,200 in 60 DAYS.", "A line more of 60 days."]))))
    return d.withColumn("new", new)


VERSIONS_SQL = r"""WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(translate(replace(text, '…', '...'), '‘’“”–—', '''''""--'), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))),
 lambda x: NOT regexp_matches(x, '(?i)^(?:\s*|\[[^\]]*\]\([^)]*\)|(?:last\s+updated|last\s+reviewed/updated)\s*:?.*|skip\s+to\b.*|[-*_]{3,}|return to top|print|share)$')) AS old FROM documents),
v AS (SELECT doc_id, old, CASE doc_id % 4 WHEN 0 THEN old WHEN 1 THEN list_reverse(old) WHEN 2 THEN list_transform(old, lambda x: translate(x, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || '!') ELSE list_concat(list_filter(old, lambda x, i: i > 1), ['A line more of 60 days.', 'You must file I-20 by Sept. 5, 2026 for $1,200 in 60 DAYS.', 'A line more of 60 days.']) END AS new FROM d),
a AS (SELECT doc_id, unnest(old) AS line, 1 AS o, 0 AS n FROM v UNION ALL SELECT doc_id, unnest(new), 0, 1 FROM v),
c AS (SELECT doc_id, line, sum(n) - sum(o) AS d FROM a GROUP BY ALL HAVING sum(n) <> sum(o)) """


@query(VERSIONS_SQL + f""", z AS (SELECT doc_id, unnest(old) AS line, unnest(range(0, len(old))) AS pos, 0 AS n FROM v UNION ALL SELECT doc_id, unnest(new), unnest(range(0, len(new))), 1 FROM v),
y AS (SELECT doc_id, line, min(pos) FILTER (WHERE n = 1) AS a1, min(pos) FILTER (WHERE n = 0) AS a0, sum(2 * n - 1) AS d FROM z GROUP BY ALL HAVING d <> 0),
s AS (SELECT doc_id, flatten(list(list_resize([]::VARCHAR[], greatest(d, 0)::INT, line) ORDER BY a1)) AS added, flatten(list(list_resize([]::VARCHAR[], greatest(-d, 0)::INT, line) ORDER BY a0)) AS removed FROM y GROUP BY doc_id),
w AS (SELECT doc_id, old, new, coalesce(added, []) AS added, coalesce(removed, []) AS removed FROM v LEFT JOIN s USING (doc_id)),
r AS (SELECT *, CASE WHEN old = new THEN 'identical_after_normalization' WHEN len(added) = 0 AND len(removed) = 0 THEN 'reordered_only'
 WHEN list_sort(list_transform(added, lambda x: regexp_replace(lower(x), '[^a-z0-9]+', '', 'g'))) = list_sort(list_transform(removed, lambda x: regexp_replace(lower(x), '[^a-z0-9]+', '', 'g'))) THEN 'formatting_only' ELSE 'content_lines_changed' END AS reason,
 flatten(list_transform(list_concat(added, removed), lambda x: regexp_extract_all(x, '{tx.HIGHLIGHT}'))) AS found FROM w),
q AS (SELECT *, list_transform(found, lambda x: lower(x)) AS keys FROM r)
SELECT doc_id, CASE reason WHEN 'identical_after_normalization' THEN 'unchanged' WHEN 'content_lines_changed' THEN 'meaningful' ELSE 'cosmetic' END AS status, reason, md5(array_to_string(added[1:20], chr(10))) AS added, md5(array_to_string(removed[1:20], chr(10))) AS removed, len(added)::BIGINT AS added_count, len(removed)::BIGINT AS removed_count,
 array_to_string(list_filter(list_transform(found, lambda x, i: CASE WHEN list_position(keys, lower(x)) = i THEN x END), lambda x: x IS NOT NULL), '|') AS highlights FROM q""")
def classify_change(spark, sf_dir):
    out = ledger.classify(versions(spark, sf_dir), "doc_id", "old", "new")
    lines = lambda c: md5(joined(F.col(c), "\n")).alias(c)
    return out.select("doc_id", "status", "reason", lines("added"), lines("removed"), F.col("added_count").cast("long").alias("added_count"), F.col("removed_count").cast("long").alias("removed_count"), joined(F.col("highlights"), "|").alias("highlights"))


@query(VERSIONS_SQL + "SELECT doc_id, md5(line) AS line, CASE WHEN d > 0 THEN 'added' ELSE 'removed' END AS change, abs(d)::BIGINT AS n FROM c")
def line_multiset_diff(spark, sf_dir):
    v = versions(spark, sf_dir)
    return ledger.line_changes(v, "doc_id", "old", "new").select("doc_id", md5(F.col("line")).alias("line"), "change", "n")


# Evaluation. A golden row is a labelled document; its scores come from ids.

EVAL_SQL = "WITH e AS (SELECT doc_id, toxic = 1 AS is_advice, CASE WHEN doc_id % 3 = 0 THEN 'stable' ELSE 'volatile' END AS volatility, doc_id % 2 = 0 AS multi_part, CASE WHEN doc_id % 7 > 0 THEN (doc_id % 101) / 100.0::DOUBLE END AS score, (doc_id % 997) / 10.0::DOUBLE AS seconds, doc_id % 11 = 0 AS refused, (doc_id % 4)::BIGINT AS cited, (doc_id % 3)::BIGINT AS bad FROM labels) "


def evals_of(spark, sf_dir):
    x = F.expr
    return table(spark, sf_dir, "labels").select("doc_id", x("toxic = 1").alias("is_advice"), x("if(doc_id % 3 = 0, 'stable', 'volatile')").alias("volatility"), x("doc_id % 2 = 0").alias("multi_part"), x("if(doc_id % 7 > 0, (doc_id % 101) / 100.0D, null)").alias("score"), x("(doc_id % 997) / 10.0D").alias("seconds"), x("doc_id % 11 = 0").alias("refused"), x("doc_id % 4").alias("cited"), x("doc_id % 3").alias("bad"))


@query(EVAL_SQL + "SELECT round(avg(score), 9) AS mean, count(score)::BIGINT AS n, count(*)::BIGINT AS total, round(count(*) FILTER (WHERE refused AND NOT is_advice)::DOUBLE / nullif(count(*) FILTER (WHERE NOT is_advice), 0), 9) AS false_refusal, round(count(*) FILTER (WHERE is_advice AND NOT refused)::DOUBLE / nullif(count(*) FILTER (WHERE is_advice), 0), 9) AS leakage, round(sum(bad)::DOUBLE / nullif(sum(cited), 0), 9) AS bad_rate FROM e")
def eval_overall(spark, sf_dir):
    rate = lambda a, b: F.round(evals.rate(a, b), 9)
    advice, refused = F.col("is_advice"), F.col("refused")
    return evals_of(spark, sf_dir).agg(F.round(F.avg("score"), 9).alias("mean"), F.count("score").alias("n"), F.count("*").alias("total"), rate(F.count_if(refused & ~advice), F.count_if(~advice)).alias("false_refusal"), rate(F.count_if(advice & ~refused), F.count_if(advice)).alias("leakage"), rate(F.sum("bad"), F.sum("cited")).alias("bad_rate"))


@query(EVAL_SQL + "SELECT volatility, is_advice, multi_part, count(*)::BIGINT AS n, round(avg(score), 9) AS mean FROM e GROUP BY GROUPING SETS ((volatility), (is_advice), (multi_part))")
def eval_subsets(spark, sf_dir):
    sets = evals_of(spark, sf_dir).groupingSets([["volatility"], ["is_advice"], ["multi_part"]], "volatility", "is_advice", "multi_part")
    return sets.agg(F.count("*").alias("n"), F.round(F.avg("score"), 9).alias("mean"))


@query(EVAL_SQL + "SELECT min(seconds) AS least, round(quantile_cont(seconds, 0.5), 6) AS median, round(quantile_cont(seconds, 0.95), 6) AS p95, max(seconds) AS most FROM e")
def eval_latency(spark, sf_dir):
    found = evals.quantiles(evals_of(spark, sf_dir), "seconds", [0.0, 0.5, 0.95, 1.0])
    return spark.createDataFrame([tuple(None if v is None else round(v, 6) for v in found)], "least double, median double, p95 double, most double")


@query(EVAL_SQL + ", m AS (SELECT volatility, avg(score) AS v FROM e GROUP BY 1), t(volatility, op, bound) AS (VALUES ('stable', '>=', 0.4::DOUBLE), ('volatile', '<=', 0.1::DOUBLE), ('missing', '==', 0.0::DOUBLE)) SELECT t.volatility, coalesce(CASE op WHEN '>=' THEN v >= bound WHEN '<=' THEN v <= bound ELSE v = bound END, false) AS passed FROM t LEFT JOIN m USING (volatility)")
def eval_gates(spark, sf_dir):
    """A threshold without a measure fails."""
    m = evals_of(spark, sf_dir).groupBy("volatility").agg(F.avg("score").alias("v"))
    t = spark.createDataFrame([("stable", ">=", 0.4), ("volatile", "<=", 0.1), ("missing", "==", 0.0)], "volatility string, op string, bound double")
    return t.join(m, "volatility", "left").select("volatility", evals.verdict(F.col("v"), F.col("op"), F.col("bound")).alias("passed"))


@query(EVAL_SQL + """, c AS (SELECT is_advice, CASE doc_id % 6 WHEN 0 THEN 'answer' WHEN 1 THEN 'refusal_advice' WHEN 2 THEN 'clarify' WHEN 3 THEN 'no_answer' WHEN 4 THEN 'blocked_unverified' ELSE 'answer' END AS kind, doc_id % 13 = 0 AS errored, cited, bad FROM e)
SELECT round(count(*) FILTER (WHERE NOT is_advice AND kind <> 'answer')::DOUBLE / nullif(count(*) FILTER (WHERE NOT is_advice), 0), 9) AS false_refusal_structured, round(count(*) FILTER (WHERE is_advice AND kind = 'answer')::DOUBLE / nullif(count(*) FILTER (WHERE is_advice), 0), 9) AS advice_leakage_structured,
 count(*) FILTER (WHERE NOT is_advice)::BIGINT AS non_advice_scored, count(*) FILTER (WHERE is_advice)::BIGINT AS advice_scored, round(sum(greatest(cited - bad, 0))::DOUBLE / nullif(sum(cited), 0), 9) AS unreferenced,
 printf('%.3f', count(*) FILTER (WHERE NOT is_advice AND kind <> 'answer')::DOUBLE / count(*) FILTER (WHERE NOT is_advice)) || '(' || (count(*) FILTER (WHERE NOT is_advice))::VARCHAR || '/' || (SELECT count(*) FROM e)::VARCHAR || ')' AS cell FROM c WHERE NOT errored""")
def eval_structured(spark, sf_dir):
    """Refusals by response types; rows that failed are left out of what is scored, not of the total."""
    kinds = F.element_at(F.array(*map(F.lit, ["answer", "refusal_advice", "clarify", "no_answer", "blocked_unverified", "answer"])), F.expr("cast(doc_id % 6 as int)") + 1)
    rows = evals_of(spark, sf_dir).withColumns({"refusal": evals.refusal_class(kinds) == "REFUSAL", "ok": F.expr("doc_id % 13 <> 0")})
    advice, refused, ok = F.col("is_advice"), F.col("refusal"), F.col("ok")
    false = F.count_if(ok & ~advice & refused), F.count_if(ok & ~advice)
    out = rows.agg(F.round(evals.rate(*false), 9).alias("false_refusal_structured"), F.round(evals.rate(F.count_if(ok & advice & ~refused), F.count_if(ok & advice)), 9).alias("advice_leakage_structured"), false[1].alias("non_advice_scored"), F.count_if(ok & advice).alias("advice_scored"), F.round(evals.rate(F.sum(F.when(ok, F.greatest(F.col("cited") - F.col("bad"), F.lit(0)))), F.sum(F.when(ok, F.col("cited")))), 9).alias("unreferenced"), tx.stat_cell(evals.rate(*false), false[1], F.count("*")).alias("cell"))
    return out


@query(EVAL_SQL + """, m AS (SELECT 'mean' AS metric, avg(score) AS v FROM e UNION ALL SELECT 'refused', count(*) FILTER (WHERE refused)::DOUBLE / count(*) FROM e UNION ALL SELECT 'seconds', max(seconds) FROM e),
b(metric, base, higher, tolerance) AS (VALUES ('mean', 0.4::DOUBLE, true, 0.01::DOUBLE), ('refused', 0.2::DOUBLE, false, 0.0::DOUBLE), ('seconds', 50.0::DOUBLE, false, 1.0::DOUBLE), ('missing', 1.0::DOUBLE, true, 0.0::DOUBLE)),
c AS (SELECT metric, CASE WHEN higher THEN v >= base - tolerance ELSE v <= base + tolerance END AS passed FROM b LEFT JOIN m USING (metric))
SELECT metric, passed FROM c UNION ALL SELECT 'overall', bool_and(coalesce(passed, false)) FROM c""")
def eval_rollup(spark, sf_dir):
    """Measures against a baseline, and whether all pass; one that is missing doesn't."""
    e = evals_of(spark, sf_dir).agg(F.avg("score").alias("mean"), evals.rate(F.count_if("refused"), F.count("*")).alias("refused"), F.max("seconds").alias("seconds"))
    m = e.unpivot([], ["mean", "refused", "seconds"], "metric", "v")
    b = spark.createDataFrame([("mean", 0.4, True, 0.01), ("refused", 0.2, False, 0.0), ("seconds", 50.0, False, 1.0), ("missing", 1.0, True, 0.0)], "metric string, base double, higher boolean, tolerance double")
    c = b.join(m, "metric", "left").select("metric", evals.against_baseline(F.col("v"), F.col("base"), F.col("higher"), F.col("tolerance")).alias("passed"), F.lit(True).alias("gated"))
    return c.select("metric", "passed").unionByName(evals.roll_up(c, F.lit(False)).select(F.lit("overall").alias("metric"), "passed"))


@query("SELECT quality::BIGINT AS quality, count(*)::BIGINT AS total, count(*) FILTER (WHERE toxic = 1)::BIGINT AS advice, count(*) FILTER (WHERE toxic <> 1)::BIGINT AS non_advice FROM labels GROUP BY quality")
def golden_totals(spark, sf_dir):
    golden = table(spark, sf_dir, "labels").select(F.col("quality").cast("long").alias("quality"), (F.col("toxic") == 1).alias("is_advice"))
    return evals.golden_totals(golden, ["quality"])


#: Names of models by the language of a document that one of them made.
MODELS = {"en": "Qwen3-32b", "de": "openai/GPT-OSS:120b", "fr": "x-glm-4-qwen", "es": "gpt-oss:20b"}


@query("WITH m AS (SELECT DISTINCT source, lang FROM documents), f AS (SELECT source, lang, CASE WHEN lang IN ('de', 'es') THEN 'gpt-oss' ELSE 'qwen' END AS family FROM m) SELECT a.source, count(*)::BIGINT AS collisions, string_agg(a.lang || '-' || b.lang, ',' ORDER BY a.lang || '-' || b.lang) AS pairs FROM f a JOIN f b ON a.source = b.source AND a.family = b.family AND a.lang <> b.lang GROUP BY 1")
def model_families(spark, sf_dir):
    """The documents of a source are made by the models of their languages; which of these must not judge each other."""
    name = F.element_at(F.create_map(*(F.lit(x) for pair in MODELS.items() for x in pair)), F.col("lang"))
    made = table(spark, sf_dir, "documents").select("source", "lang", name.alias("model")).distinct()
    told = evals.collisions(made, made.select(F.col("model").alias("judge"))).where("judge <> model")
    langs = made.select(F.col("model").alias("judge"), F.col("lang").alias("other"), "source")
    pairs = made.join(told, "model").join(langs, ["judge", "source"]).select("source", F.concat_ws("-", "other", "lang").alias("pair"))
    return pairs.groupBy("source").agg(F.count("*").alias("collisions"), joined(F.array_sort(F.collect_list("pair"))).alias("pairs"))


@query(r"SELECT doc_id, round(0.39::DOUBLE * w / s + 11.8::DOUBLE * y / w - 15.59::DOUBLE, 6) AS grade FROM (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+')) AS w, greatest(1, len(regexp_extract_all(text, '[.!?]+'))) AS s, greatest(1, len(regexp_extract_all(text, '[aeiouyAEIOUY]+'))) AS y FROM documents) WHERE w > 0")
def reading_grade(spark, sf_dir):
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("double")
    rows = table(spark, sf_dir, "documents").select("doc_id", n("[A-Za-z]+").alias("w"), F.greatest(F.lit(1.0), n("[.!?]+")).alias("s"), F.greatest(F.lit(1.0), n("[aeiouyAEIOUY]+")).alias("y"))
    return rows.where("w > 0").select("doc_id", F.round(tx.grade(F.col("w"), F.col("s"), F.col("y")), 6).alias("grade"))


@query("SELECT n_regionkey::BIGINT AS k, count(*)::BIGINT AS n FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey <> 2) GROUP BY 1")
def fk_integrity(spark, sf_dir):
    parents = table(spark, sf_dir, "region").where("r_regionkey <> 2").select(F.col("r_regionkey").alias("n_regionkey"))
    return table(spark, sf_dir, "nation").join(parents, "n_regionkey", "left_anti").groupBy(F.col("n_regionkey").cast("long").alias("k")).agg(F.count("*").alias("n"))


from . import answers as _answers  # noqa: E402, F401
from . import upkeep as _upkeep  # noqa: E402, F401
from . import flows as _flows  # noqa: E402, F401
