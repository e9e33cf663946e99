"""Measures of an evaluation, and the gates that they must pass."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as tx

# Whether a response type counts as a refusal.
REFUSALS = {"answer": "ANSWER", "refusal_advice": "REFUSAL", "clarify": "REFUSAL", "no_answer": "REFUSAL", "blocked_unverified": "REFUSAL"}
#: Values that are taken to the driver to read quantiles from.
FEW = 10_000


def rate(part: Column, whole: Column) -> Column:
    """A share; null for a share of nothing."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def refusal_class(response_type: Column) -> Column:
    """ANSWER or REFUSAL by the response type; any other, and none, is an error."""
    out = None
    for kind, name in REFUSALS.items():
        out = F.when(response_type == kind, name) if out is None else out.when(response_type == kind, name)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown response type: "), F.coalesce(response_type, F.lit("null")))).cast("string"))


def verdict(value: Column, op: Column, bound: Column) -> Column:
    """Whether a value passes its gate; a missing value fails, a measure without an operator isn't gated (null)."""
    passed = F.when(op == ">=", value >= bound).when(op == "<=", value <= bound).when(op == "==", value == bound)
    return F.when(op.isNotNull(), F.coalesce(passed, F.lit(False)))


def against_baseline(value: Column, baseline: Column, higher_is_better: Column, tolerance: Column) -> Column:
    """Whether a value is no worse than the baseline; null if either is missing."""
    return F.when(higher_is_better, value >= baseline - tolerance).otherwise(value <= baseline + tolerance)


def roll_up(verdicts: DataFrame, errored: Column) -> DataFrame:
    """One row: passed, gated, failed of verdicts (gated, passed). A gated one without a verdict fails, and so does a run with ``errored`` rows."""
    bad = F.col("gated") & ~F.coalesce("passed", F.lit(False))
    return verdicts.agg((~F.coalesce(F.bool_or(bad), F.lit(False)) & ~errored).alias("passed"), F.count_if("gated").alias("gated"), F.count_if(bad).alias("failed"))


def quantiles(rows: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles, by linear interpolation between the two values next to each.

    The range of values that holds a rank is cut in a thousand parts, of which sums tell the one that holds it, until it
    has FEW values or only one value; so nothing is sorted whole. Nulls and NaN are left out; infinite values stand below or above all
    others, and between an infinite value and another one there is nothing but the infinite one, the lower of two.
    """
    all_values = rows.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    finite = F.abs("v") < math.inf
    values = all_values.where(finite)
    below, n, low, high = all_values.agg(F.count_if(F.col("v") == -math.inf), F.count("*"), F.min(F.when(finite, F.col("v"))), F.max(F.when(finite, F.col("v")))).first()
    if not n:
        return [None] * len(shares)
    within = values.count() if low is not None else 0

    def ranked(rank: int, low: float, high: float) -> float:
        rank -= below
        if rank < 0 or rank >= within:
            return -math.inf if rank < 0 else math.inf
        before = 0
        while low < high:
            inside = values.where(F.col("v").between(low, high))
            part = F.least(F.lit(999), F.floor((F.col("v") / 2 - low / 2) / (high / 2 - low / 2) * 1000))  # halves, as the range may be above the greatest number
            for r in sorted(inside.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect(), key=lambda r: r["part"]):
                if before + r["n"] > rank:
                    low, high, held = r["a"], r["b"], r["n"]
                    break
                before += r["n"]
            if held <= FEW:
                return sorted(r["v"] for r in values.where(F.col("v").between(low, high)).collect())[rank - before]
        return low

    out = []
    for share in shares:
        k = (n - 1) * share
        a, b = ranked(math.floor(k), low, high), ranked(math.ceil(k), low, high)
        between = k - math.floor(k)
        out.append(a if not between or a == b or math.isinf(a) else b if math.isinf(b) else a + (b - a) * between)
    return out


def golden_totals(golden: DataFrame, by: list[str] | None = None) -> DataFrame:
    """total, advice, non_advice of golden rows (is_advice, ...), for all or for each value of ``by``; a row of unknown kind is in the total alone."""
    counts = [F.count("*").alias("total"), F.count_if("is_advice").alias("advice"), F.count_if(~F.col("is_advice")).alias("non_advice")]
    return golden.groupBy(*(by or [])).agg(*counts)


def collisions(generators: DataFrame, judges: DataFrame) -> DataFrame:
    """judge, model, family: each generator (model) of a judge's (judge) own family, which must not grade it. A name of no known family is an error."""
    of = lambda c: tx.model_family(F.col(c)).alias("family")
    return generators.select("model", of("model")).distinct().join(judges.select("judge", of("judge")).distinct(), "family").select("judge", "model", "family")
