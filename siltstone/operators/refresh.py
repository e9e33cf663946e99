"""Refreshing a corpus: where a fetched source goes, what a run reports, and how tables are brought in line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMINAL = ["unchanged", "cosmetic", "meaningful", "fetch_failed", "robots_disallowed"]
ANNOTATIONS = ["rule_effective_date", "rule_status", "rule_status_source", "rule_status_source_evidences_status"]


def settle_fetches(attempts: DataFrame, most: int = 3) -> DataFrame:
    """source_url, attempts, outcome, body, http_status of (source_url, attempt, outcome, body, http_status).

    A page ends a source's attempts, and so do robots that refuse; else the last of up to ``most`` attempts counts.
    """
    tried = attempts.where(F.col("attempt") <= most)
    final = F.struct(F.when(F.col("outcome").isin("ok", "robots"), F.col("attempt")).otherwise(most + 1 - F.col("attempt") + most).alias("rank"), "attempt", "outcome", "body", "http_status")
    return tried.groupBy("source_url").agg(F.min(final).alias("f")).select("source_url", F.col("f.attempt").alias("attempts"), "f.outcome", "f.body", "f.http_status")


def route_sources(fetched: DataFrame, sources: DataFrame, chunks: DataFrame, verdict: Column) -> DataFrame:
    """source_url, status, reason, path of every fetched source.

    ``sources``: (source_url, last_indexed_body), ``chunks``: (source_url); ``verdict``: unchanged, cosmetic or meaningful
    of a fetched body against the indexed one. A source without a body that has chunks lacks its baseline: an error, not a
    first index. path is reindex, verify_only or record_failure.
    """
    held = chunks.select("source_url").distinct().withColumn("__chunked", F.lit(True))
    rows = fetched.join(sources, "source_url", "left").join(held, "source_url", "left")
    known, chunked = F.col("last_indexed_body").isNotNull(), F.coalesce("__chunked", F.lit(False))
    ok = F.col("outcome") == "ok"
    status = F.when(F.col("outcome") == "robots", "robots_disallowed").when(~ok | (~known & chunked), "fetch_failed").when(known, verdict).otherwise("meaningful")
    reason = F.when(F.col("outcome") == "robots", "robots_disallowed").when(~ok, F.col("outcome")).when(~known & chunked, "baseline_missing").when(~known, "no_existing_snapshot").otherwise("compared")
    path = F.when(status.isin("fetch_failed", "robots_disallowed"), "record_failure").when(status == "meaningful", "reindex").otherwise("verify_only")
    return rows.select("source_url", status.alias("status"), reason.alias("reason"), path.alias("path"))


def pending(sources: DataFrame, state: DataFrame, run_id: str) -> DataFrame:
    """Sources that the run has no terminal state of yet."""
    done = state.where((F.col("run_id") == run_id) & F.col("status").isin(TERMINAL)).select("source_url")
    return sources.join(done, "source_url", "left_anti")


def bookkeep(sources: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """``sources`` after a run's results (source_url, status, reason, http_status): checks that worked move the clocks and clear
    failures, those that failed count one more, robots that refuse change neither; others stay as they are."""
    rows = sources.join(results.select("source_url", F.col("status").alias("__s"), F.col("reason").alias("__r"), F.col("http_status").alias("__h")), "source_url", "left")
    s = F.col("__s")
    good, bad = s.isin("unchanged", "cosmetic", "meaningful"), s == "fetch_failed"
    new = {
        "status": F.when(good, "ok").otherwise(F.coalesce(s, F.col("status"))),
        "consecutive_failures": F.when(good, 0).when(bad, F.col("consecutive_failures") + 1).otherwise(F.col("consecutive_failures")),
        "last_error": F.when(good, F.lit(None)).otherwise(F.coalesce("__r", "last_error")),
        "last_http_status": F.when(good | (s == "robots_disallowed"), F.lit(None)).when(bad, F.col("__h")).otherwise(F.col("last_http_status")),
        "last_verified_at": F.when(good, now).otherwise(F.col("last_verified_at")),
        "last_success_at": F.when(good, now).otherwise(F.col("last_success_at")),
        "last_changed_at": F.when(s == "meaningful", now).otherwise(F.col("last_changed_at")),
        "change_count": F.col("change_count") + F.when(s == "meaningful", 1).otherwise(0),
    }
    return rows.select(*(new[c].alias(c) if c in new else F.col(c) for c in sources.columns))


def golden_impact(sources: DataFrame, golden: DataFrame) -> DataFrame:
    """source_url, rows: how many golden rows (row, source_urls) name a source (source_url, resolved_url) by either of its addresses."""
    named = golden.select("row", F.explode(F.array_distinct("source_urls")).alias("__url"))
    either = sources.select("source_url", F.explode(F.array_distinct(F.array("source_url", F.coalesce(F.nullif("resolved_url", F.lit("")), F.col("source_url"))))).alias("__url"))
    hits = either.join(named, "__url").groupBy("source_url").agg(F.countDistinct("row").alias("rows"))
    return sources.select("source_url").join(hits, "source_url", "left").select("source_url", F.coalesce("rows", F.lit(0)).alias("rows"))


def report(results: DataFrame, impact: DataFrame) -> DataFrame:
    """One row: how many sources have each of the terminal states, nought among them, and exit_code.

    The code is 1 if a fetch failed, or if a changed source has golden rows, or if it isn't known whether it has (no row in ``impact``).
    """
    rows = results.join(impact.withColumnRenamed("rows", "__rows"), "source_url", "left")
    review = (F.col("status") == "meaningful") & (F.col("__rows").isNull() | (F.col("__rows") > 0))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in TERMINAL]
    return rows.agg(*counts, F.coalesce(F.max(F.when((F.col("status") == "fetch_failed") | review, 1).otherwise(0)), F.lit(0)).alias("exit_code"))


def report_line(label: Column, status: Column, fetched: Column, reason: Column, chunks: Column, width: int) -> Column:
    """A row of the table that people read; a longer label or reason is shown whole."""
    pad = lambda c, n: F.when(F.length(c) < n, F.rpad(c, n, " ")).otherwise(c)
    number = chunks.cast("string")
    return F.concat_ws(" ", pad(label, width), pad(status, 12), pad(fetched, 8), pad(F.coalesce(reason, F.lit("")), 28), F.when(F.length(number) < 6, F.lpad(number, 6, " ")).otherwise(number))


def backfill(sources: DataFrame, snapshots: DataFrame) -> DataFrame:
    """source_url, last_indexed_body, action: every source with its snapshot's body where it had none, and every snapshot of no source. Actions: updated,
    already_populated, no_snapshot, still_null and no_sources_row."""
    rows = sources.withColumn("__source", F.lit(True)).join(snapshots.select("source_url", F.col("body").alias("__body")), "source_url", "full_outer")
    had, snap = F.col("last_indexed_body").isNotNull(), F.col("__body").isNotNull()
    done = F.when(F.col("__source").isNull(), "no_sources_row").when(had & snap, "already_populated").when(snap, "updated").when(had, "no_snapshot").otherwise("still_null")
    return rows.select("source_url", F.when(F.col("__source"), F.coalesce("last_indexed_body", "__body")).alias("last_indexed_body"), done.alias("action"))


def sync_annotations(manifest: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks with the manifest's annotations, a report with a row for each of its sources).

    Annotations move together, and one that the manifest doesn't state becomes null; chunks of no entry stay as they are.
    Report: source_url, changed, documents_rows (that change), not_in_corpus, before_is_mixed.
    """
    before = chunks.groupBy("source_url").agg(F.count("*").alias("n"), F.collect_set(F.struct(*ANNOTATIONS)).alias("kinds"))
    rows = manifest.join(before, "source_url", "left")
    missing, wanted = F.col("n").isNull(), F.struct(*ANNOTATIONS)
    changed = ~missing & ~((F.size("kinds") == 1) & F.element_at("kinds", 1).eqNullSafe(wanted))
    told = rows.select("source_url", changed.alias("changed"), F.when(changed, F.col("n")).otherwise(0).alias("documents_rows"), missing.alias("not_in_corpus"), (~missing & (F.size("kinds") > 1)).alias("before_is_mixed"))
    new = manifest.select("source_url", F.struct(*ANNOTATIONS).alias("__new"))
    out = chunks.join(new, "source_url", "left")
    return out.select(*(F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in ANNOTATIONS else F.col(c) for c in chunks.columns)), told


def schema_drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """table_name, column_name, drift, fatal of (table_name, column_name, data_type, nullable, has_default) on both sides.

    A table or column that is missing is fatal; one too many is so only if rows that don't name it would fail. Of a table
    on one side only, its columns aren't listed.
    """
    side = lambda df, flag: df.select("table_name", "column_name", F.lit(True).alias(flag), *( [(~F.col("nullable") & ~F.col("has_default")).alias("breaks")] if flag == "b" else []))
    tables = expected.select("table_name").distinct().withColumn("a", F.lit(True)).join(actual.select("table_name").distinct().withColumn("b", F.lit(True)), "table_name", "full_outer")
    odd = tables.where("a is null or b is null").select("table_name", F.lit(None).cast("string").alias("column_name"), F.when(F.col("a").isNull(), "extra_table").otherwise("missing_table").alias("drift"), F.col("a").isNotNull().alias("fatal"))
    both = tables.where("a and b").select("table_name")
    columns = side(expected, "a").join(side(actual, "b"), ["table_name", "column_name"], "full_outer").join(both, "table_name", "left_semi").where("a is null or b is null")
    return odd.unionByName(columns.select("table_name", "column_name", F.when(F.col("a").isNull(), "extra_column").otherwise("missing_column").alias("drift"), (F.col("a").isNotNull() | F.coalesce("breaks", F.lit(False))).alias("fatal")))


def store_answers(cache: DataFrame, new: DataFrame, version: str) -> DataFrame:
    """The cache (query_id, embedding, corpus_version, response_type, response) after new answers: rows of other versions go, and only answers
    and refusals of advice are kept."""
    good = new.where(F.col("response_type").isin("answer", "refusal_advice")).withColumn("corpus_version", F.lit(version))
    return cache.where(F.col("corpus_version") == version).unionByName(good.select(cache.columns))
