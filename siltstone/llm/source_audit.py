"""How far the sources of a language are apart in the words they use, by inclusion and exclusion over supports.

A group is a source within a language, its support the kept terms that it holds. With z for a group's share of a term that
it doesn't hold, the distance of groups g and h over all V kept terms is

    V * |z_g - z_h|                                                      as if no term stood in either
    + sum over g's support of |p_g - z_h| - |z_g - z_h|, and the same for h    as if no term stood in both
    + sum over both supports of |p_g - p_h| - |p_g - z_h| - |z_g - p_h| + |z_g - z_h|.

The first part is a constant. The second depends on a term's count only, so a histogram of counts for each group prices it
for all other groups, whatever the number of terms. Only the third needs the postings of both groups, joined on the term.
Pairs of groups are made by blocks of sources, and a term that many sources hold is dealt out in parts, so that no task
gets all of a language or of a term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, slices
from .tokens import LETTERS, coded, split_words

#: Documents of a language that a kept term stands in, at least; what is added to each count; the scale of shares.
LEAST, PRIOR, SCALE = 30, 5, 1_000_000_000
#: Terms of a group that are listed.
TERMS = 50
#: Sources of a block, and sources of a term that a task pairs with all others.
BLOCK = 256


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, count, docs) of a few documents at a time."""
    for batch in slices(batches):
        found, at = split_words(batch.column("text"), LETTERS)
        code, terms = coded(found)
        if not len(code):
            continue
        pairs = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"])
        names = {}
        group = np.array([names.setdefault((g["lang"], g["source"]), len(names)) for g in pairs.to_pylist()], np.int64)
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        once, times = np.unique(doc * len(terms) + code, return_counts=True)  # a term of a document
        key, place = np.unique(group[once // len(terms)] * len(terms) + once % len(terms), return_inverse=True)
        count, docs = np.bincount(place, times, len(key)).astype(np.int64), np.bincount(place, minlength=len(key))
        lang, source = (pa.array([n[i] for n in names], pa.string()).take(pa.array(key // len(terms))) for i in (0, 1))
        term = terms.take(pa.array(key % len(terms))).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([lang, source, term, pa.array(count), pa.array(docs.astype(np.int64))], ["lang", "source", "term", "count", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, docs: occurrences of each term in a group, and the group's documents that hold it."""
    held = docs.select("lang", "source", "text").mapInArrow(_counts, "lang string, source string, term binary, count long, docs long")
    return held.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exactly; null without terms."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(19,0)")
    below = F.nullif(total + PRIOR * terms, F.lit(0)).cast("decimal(19,0)")
    return F.when(terms > 0, 1 + F.call_function("div", above, below))


def audit(docs: DataFrame, least: int = LEAST, terms: int = TERMS, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: each other source of the language with its distance; part ``term``: the ``terms`` kept terms whose share in
    the group most exceeds that in the language. Null languages, sources and texts read as empty. Groups without terms have
    the shares that no counts give, and distance 0 where their language keeps no term. Repeated rows count each; other
    columns are left out; an empty table gives no rows.
    """
    told = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    named = W.partitionBy("lang", "term")
    held = term_counts(told).withColumns({"docs": F.sum("docs").over(named), "of_lang": F.sum("count").over(named), "sources": F.count("*").over(named), "first": F.min("source").over(named) == F.col("source")})
    kept = cut(held.where(F.col("docs") >= least).drop("docs"), "audit-postings")

    totals = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = told.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    vocabulary = kept.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("v"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    langs = langs.join(vocabulary, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    zero = F.coalesce(share(F.lit(0), F.col("total"), F.col("v")), F.lit(0)).alias("zero")
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block")
    groups = cut(groups.join(langs, "lang").select("lang", "source", "total", "lang_total", "v", "blocks", block, zero), "audit-groups")
    priced = cut(
        kept.join(groups, ["lang", "source"]).select(
            "lang", "source", "term", "count", "sources", "zero", "block", "blocks",
            share(F.col("count"), F.col("total"), F.col("v")).alias("p"), share(F.col("of_lang"), F.col("lang_total"), F.col("v")).alias("q"),
        ),
        "audit-priced",
    )
    return pairs(groups, priced).unionByName(leading(priced, terms))


def pairs(groups: DataFrame, priced: DataFrame) -> DataFrame:
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    # one-sided terms by their counts, and the constant of each group as a row of its own
    histogram = priced.groupBy("lang", "source", "block", "blocks", "zero", "count", "p").agg(F.count("*").alias("n")).withColumn("constant", F.lit(False)).drop("count")
    constant = groups.select("lang", "source", "block", "blocks", "zero", F.col("zero").alias("p"), F.col("v").alias("n"), F.lit(True).alias("constant"))
    mine = histogram.unionByName(constant).withColumn("against", F.explode(others))
    theirs = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("item_zero"), F.col("block").alias("against"), F.explode(others).alias("block"))
    met = mine.join(theirs, ["lang", "block", "against"]).where("source <> item")
    apart = F.abs(F.col("zero") - F.col("item_zero"))
    one_sided = F.col("n") * (F.abs(F.col("p") - F.col("item_zero")) - apart)
    value = F.when(F.col("constant"), F.when(F.col("source") < F.col("item"), F.col("n") * apart).otherwise(0)).otherwise(one_sided)
    singles = met.groupBy("lang", F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b")).agg(F.sum(value).alias("value"))

    # terms that both hold: a term's sources are dealt out in parts, and each part meets all of them
    parts = F.ceil(F.col("sources") / BLOCK).cast("int")
    left = priced.select("lang", "term", F.pmod(F.xxhash64("source"), parts).cast("int").alias("part"), F.col("source").alias("a"), F.col("p").alias("p_a"), F.col("zero").alias("z_a"))
    right = priced.select("lang", "term", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("source").alias("b"), F.col("p").alias("p_b"), F.col("zero").alias("z_b"))
    both = left.join(right, ["lang", "term", "part"]).where("a < b")
    more = F.abs(F.col("p_a") - F.col("p_b")) - F.abs(F.col("p_a") - F.col("z_b")) - F.abs(F.col("z_a") - F.col("p_b")) + F.abs(F.col("z_a") - F.col("z_b"))
    overlaps = both.groupBy("lang", "a", "b").agg(F.sum(more).alias("value"))

    sums = singles.unionByName(overlaps).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    out = sums.select("lang", sides.alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
    return out.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def leading(priced: DataFrame, terms: int = TERMS) -> DataFrame:
    above = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return above.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= terms)


AUDIT_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST}),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
full_counts AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (SELECT f.lang, source, term, n, 1 + (1000000000 * (n + {PRIOR})) // (sum(n) OVER (PARTITION BY f.lang, source) + {PRIOR} * v) AS p FROM full_counts f JOIN v USING (lang)),
l AS (SELECT lang, term, sum(n) AS n FROM full_counts GROUP BY lang, term),
q AS (SELECT l.lang, term, 1 + (1000000000 * (n + {PRIOR})) // (sum(n) OVER (PARTITION BY l.lang) + {PRIOR} * v) AS q FROM l JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
UNION ALL SELECT p.lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts
QUALIFY part = 'pair' OR rank <= {TERMS}
"""
