"""Bookkeeping of sources, usage and versions: state after a batch is a table computed from the state before and the batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import text as tx


def failure_counts(checks: DataFrame, key: str, order: list[str], failed: Column, skipped: Column) -> DataFrame:
    """Every check with ``consecutive_failures`` after it: a failure adds one, a success resets, a skipped one changes nothing."""
    run = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = checks.withColumn("__fail", F.when(skipped, 0).when(failed, 1).otherwise(0)).withColumn("__epoch", F.sum(F.when(~failed & ~skipped, 1).otherwise(0)).over(run))
    within = W.partitionBy(key, "__epoch").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return out.withColumn("consecutive_failures", F.sum("__fail").over(within)).drop("__fail", "__epoch")


def health(failures: Column, last_error: Column, age_hours: Column) -> Column:
    """broken: robots refuse, three failures and more, no success ever, or none for seven days."""
    return F.when((last_error == "robots_disallowed") | (failures >= 3) | age_hours.isNull() | (age_hours > 168), "broken").otherwise("ok")


def freshness(age_hours: Column) -> Column:
    return F.when(age_hours.isNull(), "unknown").when(age_hours <= 24, "current").when(age_hours <= 168, "recent").otherwise("stale")


def age_hours(now: Column, then: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(now) - micros(then)) / 3.6e9


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key it doesn't have."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.join(old.select(key).distinct(), key, "left_anti"))


def increment(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    return old.unionByName(new).groupBy(key).agg(F.sum(value).alias(value))


def replace_group(old: DataFrame, new: DataFrame, touched: DataFrame, key: str) -> DataFrame:
    """All rows of touched keys give way to those of ``new``."""
    return old.join(touched.select(key).distinct(), key, "left_anti").unionByName(new)


def differences(old: Column, new: Column) -> Column:
    """Of two arrays of lines, as multisets: structs of line, d (how many more times it stands in the new one), at0 and at1 (where it first stands
    in either), of the lines that differ. Both arrays are sorted with the lines' places, and runs of equal lines are counted and met as neighbours."""
    none = F.array().cast("array<string>")

    def runs(lines: Column, side: int) -> Column:
        def counted(s: Column) -> Column:
            starts = F.filter(F.transform(s, lambda x, j: F.when((j == 0) | (F.get(s, j - 1)["line"] != x["line"]), j)), lambda j: j.isNotNull())
            return tx.let(starts, lambda b: F.transform(b, lambda j, k: F.struct(F.get(s, j)["line"].alias("line"), F.lit(side).alias("side"), (F.coalesce(F.get(b, k + 1), F.size(s)) - j).alias("n"), F.get(s, j)["at"].alias("at"))))

        return tx.let(F.sort_array(F.transform(F.coalesce(lines, none), lambda x, i: F.struct(x.alias("line"), i.alias("at")))), counted)

    def met(s: Column) -> Column:
        def each(x: Column, j: Column) -> Column:
            after = F.get(s, j + 1)
            both = (after["line"] == x["line"]) & (x["side"] == 0)
            told = lambda d, at0, at1: F.struct(x["line"].alias("line"), d.alias("d"), at0.alias("at0"), at1.alias("at1"))
            nowhere = F.lit(None).cast("int")
            alone = F.when(x["side"] == 0, told(-x["n"], x["at"], nowhere)).when(~F.coalesce(F.get(s, j - 1)["line"] == x["line"], F.lit(False)), told(x["n"], nowhere, x["at"]))
            return F.when(F.coalesce(both, F.lit(False)), told(after["n"] - x["n"], x["at"], after["at"])).otherwise(alone)

        return F.filter(F.transform(s, each), lambda x: x["d"] != 0)

    return tx.let(F.sort_array(F.concat(runs(old, 0), runs(new, 1))), met)


def line_changes(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """key, line, change (removed or added), n, at: differences of two arrays of lines as multisets, and where a line first stands on
    its side. Each pair is settled in its row."""
    more = F.col("x.d") > 0
    rows = pairs.select(key, F.explode(differences(F.col(old), F.col(new))).alias("x"))
    return rows.select(key, "x.line", F.when(more, "added").otherwise("removed").alias("change"), F.abs("x.d").alias("n"), F.when(more, F.col("x.at1")).otherwise(F.col("x.at0")).alias("at"))


#: Lines of a change that are shown.
EVIDENCE = 20


def classify(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """key, status, reason, added, removed (the first lines of each), added_count, removed_count, highlights of two arrays of lines: equal, reordered, equal but for case
    and punctuation, or another content."""
    bare = lambda c: F.sort_array(F.transform(c, lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")))

    def side(added: bool) -> Column:
        """The lines of one side by their first places, each as often as it stands there more."""
        at, sign = ("at1", 1) if added else ("at0", -1)
        own = F.filter("__differ", lambda x: x["d"] * sign > 0)
        placed = F.sort_array(F.transform(own, lambda x: F.struct(x[at].alias("at"), x["line"].alias("line"), F.abs(x["d"]).alias("n"))))
        return F.flatten(F.transform(placed, lambda x: F.array_repeat(x["line"], x["n"])))

    out = pairs.withColumn("__differ", differences(F.col(old), F.col(new)))
    out = out.withColumns({"__a": side(True), "__r": side(False)})
    reason = (
        F.when(F.col(old) == F.col(new), "identical_after_normalization")
        .when((F.size("__a") == 0) & (F.size("__r") == 0), "reordered_only")
        .when(bare(F.col("__a")) == bare(F.col("__r")), "formatting_only")
        .otherwise("content_lines_changed")
    )
    out = out.withColumn("reason", reason)
    status = F.when(F.col("reason") == "identical_after_normalization", "unchanged").when(F.col("reason") == "content_lines_changed", "meaningful").otherwise("cosmetic")
    return out.select(key, status.alias("status"), "reason", F.slice("__a", 1, EVIDENCE).alias("added"), F.slice("__r", 1, EVIDENCE).alias("removed"), F.size("__a").alias("added_count"), F.size("__r").alias("removed_count"), tx.highlights(F.concat("__a", "__r")).alias("highlights"))


def sections(docs: DataFrame, key: str, body: str) -> DataFrame:
    """key, line, level, heading, parent, breadcrumb, chunk of Markdown bodies, one row for each section.

    Headings have one to four marks and a text, and stand outside fences. The first is the title, and the text under it a section of level 1; what is above
    it is no part of the page. A later heading of level 1 is text. A heading without text of its own labels the sections after it. A body without headings is one
    section of the title Untitled.
    """
    lines = docs.select(key, F.posexplode(F.split(body, "\n")).alias("line", "text"))
    order = W.partitionBy(key).orderBy("line")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    fence = F.col("text").rlike("^\\s*(?:```|~~~)")
    lines = lines.withColumn("fenced", F.sum(F.when(fence, 1).otherwise(0)).over(upto) % 2)
    named = F.when((F.col("fenced") == 0) & ~fence, tx.let(tx.clean_heading(F.regexp_extract("text", r"^#{1,4}[ \t]+(\S.*?)\s*$", 1)), lambda x: F.nullif(x, F.lit(""))))
    lines = lines.withColumn("name", named).withColumn("mark", F.when(F.col("name").isNotNull(), F.length(F.regexp_extract("text", "^(#+)", 1))))
    lines = lines.withColumns({"nth": F.count("mark").over(upto), "headings": F.count("mark").over(W.partitionBy(key))})
    lines = lines.withColumn("opens", F.col("mark").isNotNull() & ((F.col("nth") == 1) | (F.col("mark") > 1))).where("nth > 0 or headings = 0")
    lines = lines.withColumn("section", F.sum(F.col("opens").cast("int")).over(upto))
    grouped = lines.groupBy(key, "section").agg(
        F.min("line").alias("line"),
        F.max(F.when(F.col("opens"), F.col("mark"))).alias("level"),
        F.max(F.when(F.col("opens"), F.col("name"))).alias("heading"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("opens"), F.struct("line", "text")))), lambda x: x["text"]), "\n").alias("chunk"),
    )
    grouped = grouped.withColumns({"chunk": F.regexp_replace("chunk", "^\\s+|\\s+$", ""), "heading": F.coalesce("heading", F.lit("Untitled"))})
    before = W.partitionBy(key).orderBy("section")
    label = F.when((F.length("chunk") == 0) & (F.col("section") > 1), F.col("heading"))
    grouped = grouped.withColumns({"parent": F.last(label, ignorenulls=True).over(before.rowsBetween(W.unboundedPreceding, -1)), "title": F.first("heading").over(before)})
    out = grouped.where(F.length("chunk") > 0).withColumn("level", F.when(F.col("section") <= 1, 1).otherwise(F.col("level")))
    return out.select(key, "line", "level", "heading", "parent", tx.breadcrumb(F.col("title"), F.col("parent"), F.col("heading")).alias("breadcrumb"), "chunk")
