"""Mixing sources to target weights by Pareto order sampling.

Of a source's target a document is due ``level * lean`` copies, at most ``most``: lean grows with the number of binary
digits of its size in words, so that longer documents are taken more often, and level is what makes the source's words
come to its target. Its whole copies are certain. Of the remaining fraction p it is ranked by
(u / (1 - u)) / (p / (1 - p)), u being uniform and drawn from its id, and the documents that rank lowest are taken until
their words come nearest to what the source still needs: a sample of fixed size in words, in which a document is with
probability p.

No source is ever ordered in one task. The ranks are cut into 4096 x 4096 steps; sums of words for each step, made
before the shuffle, tell in which step a source's sample ends, and only the documents in that step are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

STEPS = 4096
#: What sources weigh, by code point of their names, over and over.
CYCLE = (5.0, 2.0, 1.0)
#: What a document's lean grows by for each binary digit of its size.
LEAN = 0.125
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def digits(size: Column) -> Column:
    return F.length(F.bin(size))


def uniform(doc_id: Column, seed: int = 0) -> Column:
    """A number above 0 and below 1 from the id (null: as an empty text) by md5, the same in every run and engine."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(totals: DataFrame, share: float = 1.5, most: float = 2.0, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """source, source_size -> the same with ``target``: ``share`` of all words dealt out by weight, no target above
    ``most`` times its source, what is above dealt out again by weight until none is.

    This table has a row for each source; sources are ordered by most * size / weight, those at the front are full, and
    the rest share what is left.
    """
    named = W.orderBy(F.col("source").asc_nulls_last())
    filling, after = W.orderBy("ratio", F.col("source").asc_nulls_last()), W.unboundedPreceding
    w = F.element_at(F.array(*map(F.lit, cycle)), ((F.row_number().over(named) - 1) % len(cycle) + 1).cast("int"))
    out = totals.withColumn("weight", w).withColumn("ratio", most * F.col("source_size") / F.col("weight"))
    out = out.withColumns(
        {
            "full": F.coalesce(F.sum(most * F.col("source_size")).over(filling.rowsBetween(after, -1)), F.lit(0.0)),
            "open": F.sum("weight").over(filling.rowsBetween(0, W.unboundedFollowing)),
            "all": F.sum("source_size").over(W.partitionBy()),
        }
    )
    out = out.withColumn("level", (share * F.col("all") - F.col("full")) / F.col("open"))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(W.partitionBy())["level"]
    return out.withColumn("target", F.least(most * F.col("source_size"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))).select("source", "source_size", "target")


def dues(sums: DataFrame, goal: DataFrame, most: float) -> DataFrame:
    """__goal, digits, source_size, target, __whole, __p, __need: what a document of a source is due by the digits of its size.

    ``sums``: source, digits, words; of each source at most 64 rows. The leanest to be full are those of the most digits;
    they are due ``most``, and the rest share what is left by lean.
    """
    of = W.partitionBy("__goal").orderBy(F.desc("digits"))
    lean = 1.0 + LEAN * F.col("digits")
    out = sums.join(goal, F.col("source").eqNullSafe(F.col("__goal"))).withColumn("lean", lean)
    out = out.withColumns(
        {
            "full": F.coalesce(F.sum(most * F.col("words")).over(of.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
            "open": F.sum(F.col("lean") * F.col("words")).over(of.rowsBetween(0, W.unboundedFollowing)),
        }
    )
    out = out.withColumn("level", F.when(F.col("open") > 0, (F.col("target") - F.col("full")) / F.col("open")))
    level = F.max(F.when(F.col("level") * F.col("lean") <= most, F.struct("digits", "level"))).over(W.partitionBy("__goal"))["level"]
    out = out.withColumn("due", F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.coalesce(level, F.lit(float("inf"))) * F.col("lean"))).otherwise(F.lit(0.0)))
    out = out.withColumn("__whole", F.floor(F.col("due") + 1e-12)).withColumn("__p", F.greatest(F.lit(0.0), F.col("due") - F.col("__whole")))
    need = F.col("target") - F.sum(F.col("__whole") * F.col("words")).over(W.partitionBy("__goal"))
    return out.withColumn("__need", need).select("__goal", "digits", "source_size", "target", "__whole", "__p", "__need")


def mix(docs: DataFrame, share: float = 1.5, most: int = 2, seed: int = 0, key: str = "doc_id", source: str = "source", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target, copies and taken (copies * size) after its own columns,
    or those named in ``keep``.

    A null text has size 0, a null source is a source of its own, a source without words gets target 0. Documents of
    size 0 take no words. Rows with the same id rank alike; equal ranks go by text. Columns of ``docs`` with a new
    column's name are left out.
    """
    new = ["size", "source_size", "target", "copies", "taken"]
    own = [c for c in (docs.columns if keep is None else keep) if c not in new]
    tie = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    safe = [f"__own{i}" for i in range(len(own))]  # so that no column of docs is taken for one of those made here
    base = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(own, safe)), words(F.col(text)).alias("size"), uniform(F.col(key), seed).alias("__u"), F.col(source).alias("__source"), tie.alias("__tie"))
    base = cut(base, "mix")  # texts are read once
    sums = base.groupBy(F.col("__source").alias("source"), digits(F.col("size")).alias("digits")).agg(F.sum("size").alias("words"))
    totals = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    goal = targets(totals, share, float(most)).select(F.col("source").alias("__goal"), "source_size", "target")
    goal = cut(dues(sums, goal, float(most)), "mix-goals")  # written, its size is known: texts needn't move to it

    rank = (F.col("__u") / (1.0 - F.col("__u"))) / (F.col("__p") / (1.0 - F.col("__p")))
    fine = F.least(F.floor(rank / (1.0 + rank) * (STEPS * STEPS)), F.lit(STEPS * STEPS - 1)).cast("long")
    ranked = base.join(goal, F.col("__source").eqNullSafe(F.col("__goal")) & (digits(F.col("size")) == F.col("digits"))).withColumn("__rank", F.when(F.col("__p") > 1e-12, rank)).withColumn("__fine", F.when(F.col("__p") > 1e-12, fine))

    def ends(sums: DataFrame, step: str, before: Column) -> DataFrame:
        """For each source the step in which the sample ends, and the words of the steps before it."""
        upto = F.sum("n").over(W.partitionBy("__goal").orderBy(step))
        return sums.withColumn("upto", before + upto).where(F.col("upto") >= F.col("__need")).groupBy("__goal").agg(F.min(F.struct(F.col(step), (F.col("upto") - F.col("n")).alias("words"))).alias("x")).select("__goal", F.col("x")[step].alias(f"end_{step}"), F.col("x.words").alias(f"words_{step}"))

    def joined(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
        named = right.withColumnRenamed("__goal", "__to")
        return left.join(named, F.col("__goal").eqNullSafe(F.col("__to")), how).drop("__to")

    one = ranked.where("__fine is not null").withColumn("coarse", F.floor(F.col("__fine") / STEPS)).withColumn("fine", F.col("__fine"))
    coarse = ends(one.groupBy("__goal", "__need", "coarse").agg(F.sum("size").alias("n")), "coarse", F.lit(0))
    at = joined(one, coarse, "inner").where("coarse = end_coarse")
    first = ends(at.groupBy("__goal", "__need", "words_coarse", "fine").agg(F.sum("size").alias("n")), "fine", F.col("words_coarse"))
    tagged = joined(ranked, cut(first, "mix-ends"))
    # the documents in a source's last step, ordered
    order = W.partitionBy("__goal").orderBy("__rank", "__tie")
    last = tagged.where("__fine = end_fine").withColumn("__upto", F.col("words_fine") + F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
    last = last.withColumn("__in", F.abs(F.col("__upto") - F.col("__need")) <= F.abs(F.col("__upto") - F.col("size") - F.col("__need")))
    rest = tagged.where("__fine is null or end_fine is null or __fine <> end_fine").withColumn("__upto", F.lit(None).cast("long"))
    rest = rest.withColumn("__in", F.col("__fine").isNotNull() & (F.col("end_fine").isNull() | (F.col("__fine") < F.col("end_fine"))))
    return rest.unionByName(last).withColumn("copies", F.least(F.col("__whole") + F.col("__in").cast("long"), F.lit(most))).withColumn("taken", F.col("copies") * F.col("size")).select(*(F.col(n).alias(c) for c, n in zip(own, safe)), *new)


#: The same mix in DuckDB's SQL.
MIX_SQL = rf"""
WITH d AS (SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  (('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
r AS (SELECT *, 2.0::DOUBLE * source_size / weight AS ratio FROM w),
f AS (SELECT *, coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
             sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining, sum(source_size) OVER () AS everything FROM r),
l AS (SELECT *, (1.5::DOUBLE * everything - filled) / remaining AS level FROM f),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce((SELECT level FROM l WHERE level <= ratio ORDER BY ratio, level LIMIT 1), 'inf'::DOUBLE) * weight) AS target FROM l),
k AS (SELECT source, length(bin(size)) AS digits, sum(size)::BIGINT AS words FROM d GROUP BY ALL),
b AS (SELECT t.*, digits, words, 1.0::DOUBLE + {LEAN}::DOUBLE * digits AS lean FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
o AS (SELECT *, coalesce(sum(2.0::DOUBLE * words) OVER (PARTITION BY source ORDER BY digits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS filled,
             sum(lean * words) OVER (PARTITION BY source ORDER BY digits DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining FROM b),
v AS (SELECT *, CASE WHEN remaining > 0 THEN (target - filled) / remaining END AS level FROM o),
q AS (SELECT *, max(CASE WHEN level * lean <= 2.0::DOUBLE THEN struct_pack(digits, level) END) OVER (PARTITION BY source) AS chosen FROM v),
g AS (SELECT *, CASE WHEN source_size > 0 THEN least(2.0::DOUBLE, coalesce(chosen.level, 'inf'::DOUBLE) * lean) ELSE 0.0::DOUBLE END AS due FROM q),
h AS (SELECT *, floor(due + 1e-12::DOUBLE)::BIGINT AS whole, greatest(0.0::DOUBLE, due - floor(due + 1e-12::DOUBLE)) AS p FROM g),
n AS (SELECT *, target - sum(whole * words) OVER (PARTITION BY source) AS need FROM h),
c AS (SELECT d.doc_id, d.size, n.source, n.source_size, n.target, n.whole, n.p, n.need, md5(coalesce(d.text, '')) AS tie, CASE WHEN n.p > 1e-12 THEN (d.u / (1.0::DOUBLE - d.u)) / (n.p / (1.0::DOUBLE - n.p)) END AS odds
      FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source AND length(bin(d.size)) = n.digits),
x AS (SELECT *, sum(size) OVER (PARTITION BY source, odds IS NULL ORDER BY odds, tie ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM c)
SELECT doc_id, size, source_size, target,
       (least(whole + CASE WHEN odds IS NOT NULL AND (upto < need OR upto - size < need AND abs(upto - need) <= abs(upto - size - need)) THEN 1 ELSE 0 END, 2) * size)::BIGINT AS taken
FROM x
"""
