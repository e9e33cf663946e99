"""From questions to responses as one plan: each gate passes on only the questions that it leaves open to the costlier stage after it.

The order is that of a single question: script and vagueness, which need the question alone; the cache; retrieval; the day's budget; the
generator; the checks of its answer; and what asks for advice. Questions of one text are answered once.

A question's passages go through all stages as what ``retrieve`` gives of them. Where texts are long that should be ids, as the same texts lead for many
questions; a generator looks up what it reads of them, for the questions that reach it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import prose
from siltstone.functions import text as tx
from siltstone.sources import scratch

from .answers import first_failing_check

#: Types that a cache keeps, and the best passage's least score.
KEPT, LEAST = ("answer", "refusal_advice"), 0.8
OUT = ["query_id", "response_type", "refusal_reason", "contexts", "answer"]


def key_of(question: Column) -> Column:
    """Questions that differ in case and white space only are one."""
    return F.lower(F.trim(F.regexp_replace(question, r"\s+", " ")))


def stub(asked: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """query_id, answer of (query_id, question, passages): a generator without a model, which cites its passages and begins the first.

    ``texts``: (id, content), for passages of ids; of a repeated id the least text counts. Only beginnings move.
    """
    begins = lambda c: F.left(c, F.lit(100))
    n, first = F.size("passages").alias("n"), F.col("passages")[0]
    if texts is None:
        asked = asked.select("query_id", n, begins(first["content"]).alias("content"))
    else:
        led = asked.select("query_id", n, first["id"].alias("id")).join(texts.select("id", begins(F.col("content")).alias("content")), "id", "left")
        asked = led.groupBy("query_id", "n").agg(F.min("content").alias("content"))
    return asked.select("query_id", F.concat(prose.stub_answer(F.col("n")), F.lit(" "), F.regexp_replace("content", r"\s+", " ")).alias("answer"))


class Stages:
    """How many questions each stage got, once all has run."""

    def __init__(self):
        self.seen: dict[str, Observation] = {}

    def told(self, df: DataFrame, stage: str) -> DataFrame:
        self.seen[stage] = Observation(stage)
        return scratch.written(df.observe(self.seen[stage], F.count("*").alias("n")), stage)

    def counts(self) -> dict[str, int]:
        return {k: o.get["n"] for k, o in self.seen.items()}


def respond(
    questions: DataFrame,
    retrieve: Callable[[DataFrame], DataFrame],
    generate: Callable[[DataFrame], DataFrame] = stub,
    cache: DataFrame | None = None,
    cap: int = 0,
    secrets: list[str] | None = None,
    stages: Stages | None = None,
) -> DataFrame:
    """query_id, response_type, refusal_reason, contexts, answer of each (query_id, question).

    ``retrieve``: (query_id, text) -> (query_id, position, score, ...), positions from 1, the rest, as content or ids, being what ``generate`` gets; ``cache``: (key, response_type, answer); ``cap``: questions that may reach the
    generator, by query_id, 0 for all; ``secrets``: spans of the prompt that no answer may repeat. A null question is too vague.
    """
    stages = stages or Stages()
    q = F.coalesce("question", F.lit(""))
    gate = F.when(tx.other_script(q), F.struct(F.lit("no_answer").alias("t"), F.lit("non_latin_script_unsupported").alias("r"))).when(tx.too_vague(q), F.struct(F.lit("clarify").alias("t"), F.lit("query_too_vague").alias("r")))
    first = scratch.written(questions.select("query_id", "question", key_of(q).alias("key"), gate.alias("gate")), "gated")
    shut = first.where("gate IS NOT NULL").select("query_id", F.col("gate.t").alias("response_type"), F.col("gate.r").alias("refusal_reason"), F.lit(0).alias("contexts"), F.lit(None).cast("string").alias("answer"))
    # one question of each text goes on
    ahead = first.where("gate IS NULL").withColumn("asked_by", F.min("query_id").over(W.partitionBy("key"))).select("query_id", "question", "key", "asked_by")
    leads = ahead.where("query_id = asked_by").select("query_id", "question", "key")
    known = leads.limit(0).select("query_id", F.lit("").alias("response_type"), F.lit("").alias("answer"))
    if cache is not None:
        known = scratch.written(leads.join(cache, "key").select("query_id", "response_type", "answer"), "known")
        leads = leads.join(known, "query_id", "left_anti")
    hit = known.select("query_id", "response_type", F.when(F.col("response_type") == "refusal_advice", "query_asks_for_personal_advice").alias("refusal_reason"), F.lit(0).alias("contexts"), "answer")

    leads = stages.told(leads.select("query_id", "question"), "retrieval")
    found = retrieve(leads.select("query_id", F.col("question").alias("text")))
    told = [c for c in found.columns if c not in ("query_id", "position")]
    passages = F.transform(F.array_sort(F.collect_list(F.struct("position", *told))), lambda p: F.struct(*(p[c].alias(c) for c in told)))
    held = scratch.written(leads.join(found.groupBy("query_id").agg(passages.alias("passages")), "query_id", "left").withColumn("contexts", F.greatest(F.lit(0), F.size("passages"))), "retrieved")
    why = F.when(F.col("contexts") == 0, "no_chunks_retrieved").when(F.col("passages")[0]["score"] < LEAST, "min_distance_exceeds_threshold")
    held = held.withColumn("why", why)
    good = held.where("why IS NULL")
    if cap > 0:
        last = good.select("query_id").orderBy("query_id").limit(cap).agg(F.max("query_id").alias("last"), F.count("*").alias("n")).where(F.col("n") == cap).select("last").first()
        over = F.col("query_id") > F.lit(last["last"]) if last else F.lit(False)
        held = held.withColumn("why", F.coalesce("why", F.when(over, "daily_generation_cap_reached")))
        good = held.where("why IS NULL")
    none = held.where("why IS NOT NULL").select("query_id", F.lit("no_answer").alias("response_type"), F.col("why").alias("refusal_reason"), "contexts", F.lit(None).cast("string").alias("answer"))

    good = stages.told(good.select("query_id", "question", "passages", "contexts"), "generation")
    said = stages.told(generate(good.select("query_id", "question", "passages")), "checks")
    rows = good.select("query_id", "question", "contexts").join(said, "query_id")
    cited = tx.citation_reason(tx.cited(F.col("answer")), F.col("contexts"), F.lit("answer"))
    failed = first_failing_check(cited, tx.authority_claim("answer"), tx.leak_class(F.col("answer"), secrets or [], [], [], []))
    rows = rows.withColumns({"failed": failed, "advice": tx.asks_advice(F.col("question"))})
    kind = F.when(F.col("failed").isNotNull(), "blocked_unverified").when(F.col("advice"), "refusal_advice").otherwise("answer")
    reason = F.when(F.col("failed").isNotNull(), F.col("failed")).when(F.col("advice"), "query_asks_for_personal_advice")
    made = rows.select("query_id", kind.alias("response_type"), reason.alias("refusal_reason"), "contexts", F.when(F.col("failed").isNull(), F.col("answer")).alias("answer"))

    by_lead = hit.unionByName(none).unionByName(made)
    out = ahead.select("query_id", "asked_by").join(by_lead.withColumnRenamed("query_id", "asked_by"), "asked_by").select(*OUT)
    return shut.unionByName(out)


def cacheable(responses: DataFrame, questions: DataFrame) -> DataFrame:
    """key, response_type, answer: what a cache keeps of responses, one row of each question's text."""
    rows = responses.where(F.col("response_type").isin(*KEPT)).join(questions.select("query_id", key_of(F.col("question")).alias("key")), "query_id")
    return rows.groupBy("key").agg(F.min_by("response_type", "query_id").alias("response_type"), F.min_by("answer", "query_id").alias("answer"))
