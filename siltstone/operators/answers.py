"""Answers and the passages that they were made from: figures of rules not in force, notices, cards, and the route of a question.

Passages are rows (query_id, position, url, content, heading, rule_status, rule_effective_date, rule_status_source,
rule_status_source_evidences_status); positions of a query begin at 1 and are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import rules
from siltstone.functions import text as tx

NO_DAY = "9999-12-31"


def figure_sets(passages: DataFrame) -> DataFrame:
    """query_id, figure, current, and for figures of no current passage of the query also ways: structs of (undated, day,
    status) of the passages that hold it."""
    each = passages.select("query_id", F.explode(tx.figures(F.col("content"))).alias("figure"), rules.in_force(F.col("rule_status")).alias("now"), "rule_effective_date", "rule_status")
    undated = F.col("rule_effective_date").isNull()
    way = F.when(~F.col("now"), F.struct(undated.alias("undated"), F.coalesce("rule_effective_date", F.lit(NO_DAY).cast("date")).alias("day"), F.col("rule_status").alias("status")))
    out = each.groupBy("query_id", "figure").agg(F.max("now").alias("current"), F.array_sort(F.collect_set(way)).alias("ways"))
    return out.withColumn("ways", F.when(~F.col("current"), F.col("ways")))


def qualify_figures(answers: DataFrame, passages: DataFrame, today: Column) -> DataFrame:
    """query_id, text, insertions, blocked, blocked_urls of each answer (query_id, answer).

    A sentence with a figure that only passages not in force hold, and which doesn't state the rule's day, gets a sentence
    after it on the rule: of several rules that of the earliest day, dated ones first. If no figure of the sentence is
    current, the answer is blocked; the urls are those of the passages, by sentence and position.
    """
    parts = answers.select("query_id", "answer", F.posexplode(tx.sentence_parts(F.col("answer"))).alias("i", "p")).select("query_id", "i", "p.sentence", "p.separator")
    held = parts.select("query_id", "i", "sentence", F.explode(tx.figures(F.col("sentence"))).alias("figure")).join(figure_sets(passages), ["query_id", "figure"])
    silent = held.select("query_id", "i", "sentence", "figure", "current", F.explode_outer("ways").alias("way"))
    stated = ~F.col("way.undated") & F.regexp_like("sentence", tx.date_pattern(F.col("way.day")))
    silent = silent.withColumn("way", F.when(~stated, F.col("way")))
    fired = silent.groupBy("query_id", "i").agg(F.min("way").alias("way"), F.max("current").alias("current"), F.collect_set(F.when(F.col("way").isNotNull(), F.col("figure"))).alias("firing"))
    fired = fired.where("way is not null")
    said = rules.qualifier(F.col("way.status"), F.when(~F.col("way.undated"), F.col("way.day")), today)
    shown = parts.join(fired, ["query_id", "i"], "left").withColumn("text", F.concat("sentence", F.coalesce(F.concat(F.lit(" "), said), F.lit("")), "separator"))
    whole = shown.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "").alias("text"),
        F.count("way").alias("insertions"),
        F.coalesce(F.max(F.col("way").isNotNull() & ~F.col("current")), F.lit(False)).alias("blocked"),
    )
    blame = fired.where("not current").select("query_id", "i", F.explode("firing").alias("figure"))
    sources = passages.where(~rules.in_force(F.col("rule_status"))).select("query_id", "position", "url", F.explode(tx.figures(F.col("content"))).alias("figure"))
    urls = blame.join(sources, ["query_id", "figure"]).groupBy("query_id", "url").agg(F.min(F.struct("i", "position")).alias("at"))
    urls = urls.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "url"))), lambda x: x["url"]).alias("blocked_urls"))
    return whole.join(urls, "query_id", "left").withColumn("blocked_urls", F.coalesce("blocked_urls", F.array().cast("array<string>")))


def notices(passages: DataFrame, cited: DataFrame) -> DataFrame:
    """query_id, url, position, reason and the rule's fields: one row for each source of a query that bears a rule, in the
    order of its first passage. ``cited``: (query_id, cited) with the positions that the answer cites."""
    first = W.partitionBy("query_id", "url").orderBy("position")
    one = passages.join(cited, "query_id", "left").withColumn("hit", F.coalesce(F.array_contains("cited", F.col("position").cast("int")), F.lit(False)))
    one = one.withColumns({"n": F.row_number().over(first), "any_cited": F.max("hit").over(W.partitionBy("query_id", "url"))}).where("n = 1 and (rule_status is not null or rule_effective_date is not null)")
    reason = F.when(F.col("position") == 1, "top_ranked").when(F.col("any_cited"), "cited").otherwise("retrieved")
    return one.select("query_id", "url", "position", reason.alias("reason"), "rule_status", "rule_effective_date", "rule_status_source", "rule_status_source_evidences_status")


RULE = ["rule_effective_date", "rule_status", "rule_status_source", "rule_status_source_evidences_status"]


def notice_groups(found: DataFrame) -> DataFrame:
    """query_id, the four fields of a rule, first (position), urls: a query's sources of one rule, by their positions."""
    urls = F.transform(F.array_sort(F.collect_list(F.struct("position", "url"))), lambda x: x["url"])
    return found.groupBy("query_id", *RULE).agg(F.min("position").alias("first"), F.array_distinct(urls).alias("urls"))


def notice_texts(found: DataFrame, today: Column) -> DataFrame:
    """query_id, notice: the sentences on a query's rules, joined by the order of their first passages."""
    source = F.when(F.col("rule_status_source").isNotNull(), F.array("rule_status_source")).otherwise(F.array().cast("array<string>"))
    said = notice_groups(found).withColumn("said", rules.notice(F.col("rule_status"), F.col("rule_status_source_evidences_status"), F.col("rule_effective_date"), F.col("urls"), source, today))
    return said.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "said"))), lambda x: x["said"]), " ").alias("notice"))


def context_blocks(passages: DataFrame, today: Column) -> DataFrame:
    """query_id, context: a query's passages as a prompt shows them, by position."""
    shown = rules.passage(F.col("position"), F.col("url"), F.col("content"), F.col("rule_status"), F.col("rule_effective_date"), today)
    return passages.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", shown.alias("shown")))), lambda x: x["shown"]), "\n\n").alias("context"))


def first_failing_check(citations: Column, authority: Column, leak: Column) -> Column:
    """Why an answer is withheld: its citations, then what it claims to be, then what it repeats; null if nothing."""
    return F.coalesce(citations, F.when(authority.isNotNull(), "answer_claims_official_authority"), F.when(leak.isNotNull(), "answer_reproduces_system_prompt"))


# Refusal reasons with copy of their own.
COPY = {
    "non_latin_script_unsupported": "This tool only reads English right now",
    "answer_claims_official_authority": "This answer claimed to be official, so we blocked it",
    "answer_reproduces_system_prompt": "This answer repeated this tool's own instructions, so we blocked it",
    "answer_states_not_in_force_rule_as_current": "This answer stated a rule that is not in force as current, so we blocked it",
}
DEFAULT_COPY = {"no_answer": "Where to look instead", "blocked_unverified": "This answer didn't pass our citation check"}


def heading_of(response_type: Column, reason: Column) -> Column:
    """What a withheld answer is headed by: by its reason, else by its type."""
    out = None
    for r, copy in COPY.items():
        out = F.when(reason == r, copy) if out is None else out.when(reason == r, copy)
    for t, copy in DEFAULT_COPY.items():
        out = out.when(response_type == t, copy)
    return F.when(response_type.isin(list(DEFAULT_COPY)), out)


def route(questions: DataFrame, max_distance: float = 0.5) -> DataFrame:
    """Every question with response_type and refusal_reason: what the first of the gates that holds makes of it.

    Columns: question, is_advice, cached_type, contexts (passages found), min_distance (of fused ones), over_budget, answer (as
    generated), failed (the first failing check), blocked (by a figure). Gates before the answer hide all after them.
    """
    q = F.col("question")
    gates = [
        (tx.other_script(q), "no_answer", "non_latin_script_unsupported"),
        (tx.too_vague(q), "clarify", "query_too_vague"),
        (F.col("cached_type").isNotNull(), None, None),
        (F.col("contexts") == 0, "no_answer", "no_chunks_retrieved"),
        (F.col("min_distance") > max_distance, "no_answer", "min_distance_exceeds_threshold"),
        (F.col("over_budget"), "no_answer", "daily_generation_cap_reached"),
        (F.col("failed").isNotNull(), "blocked_unverified", None),
        (F.col("blocked"), "blocked_unverified", "answer_states_not_in_force_rule_as_current"),
        (F.col("is_advice"), "refusal_advice", "query_asks_for_personal_advice"),
    ]
    kind = reason = None
    for gate, t, r in gates:
        gate = F.coalesce(gate, F.lit(False))
        own = F.col("cached_type") if t is None else F.lit(t)
        why = F.when(F.col("cached_type") == "refusal_advice", "query_asks_for_personal_advice") if t is None else F.col("failed") if r is None else F.lit(r)
        kind = F.when(gate, own) if kind is None else kind.when(gate, own)
        reason = F.when(gate, why) if reason is None else reason.when(gate, why)
    return questions.withColumns({"response_type": kind.otherwise("answer"), "refusal_reason": reason, "question_other_script": tx.other_letter(q)})


def source_cards(citations: DataFrame, passages: DataFrame, sources: DataFrame, today: Column) -> DataFrame:
    """A row for each citation (query_id, position, chunk_id, url, snippet): index, title, quote, domain, updated, verified.

    ``passages``: (query_id, chunk_id, ordinal, heading, content), of which the first of a chunk counts; ``sources``:
    (query_id, url, ordinal, page_last_updated, last_verified_at), likewise. Passages may bear their ``quote`` (``quote_of_chunk``)
    in place of their content; else it is made before they move, so that content doesn't.
    """
    told = F.col("quote") if "quote" in passages.columns else tx.quote_of_chunk(F.col("content"))
    passages = passages.select("query_id", "chunk_id", "ordinal", "heading", told.alias("__quote"))

    def first(rows: DataFrame, *by: str) -> DataFrame:
        return rows.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy("ordinal"))).where("__n = 1").drop("__n", "ordinal")

    rows = citations.join(first(passages, "query_id", "chunk_id"), ["query_id", "chunk_id"], "left").join(first(sources, "query_id", "url"), ["query_id", "url"], "left")
    quote = F.coalesce(F.nullif("__quote", F.lit("")), tx.quote_of_snippet(F.col("snippet"), F.col("heading")))
    seen = F.col("last_verified_at")
    verified = F.when(F.to_date(seen) == today, "today").otherwise(tx.short_date(seen))
    return rows.select("query_id", F.col("position").alias("index"), F.coalesce("heading", tx.hostname(F.col("url"))).alias("title"), quote.alias("quote"), "url", tx.hostname(F.col("url")).alias("domain"), tx.short_date(F.col("page_last_updated")).alias("updated"), verified.alias("verified"))
