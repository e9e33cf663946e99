"""Ranked lexical search by three rounds of uniform thresholds over postings that are partitioned by term.

A term's list holds the documents with that term, highest contribution first; a list of very many documents is cut in parts by
document. For each item, whose score of a document is the sum of its terms' contributions:

1. The heads of the item's lists are fetched and summed. The documents of the highest sums are looked up in all of the
   item's lists, and the k-th highest exact score is a lower bound of what is wanted.
2. That bound divided by the number of lists is the threshold for each of them: all entries at or above it are fetched. A
   document that is in none of these can't reach the bound. What a list might still add to one that it hasn't given is less than the
   threshold and not above the list's highest entry, and nothing if one occurrence in a document of this length would be
   worth the threshold; documents whose sum with all of that stays below the bound go.
3. The rest are looked up exactly.

Only phrases of the items' own terms are in the lists; lengths, numbers of documents and of terms are counted over all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, discard, slices
from .tokens import coded, split_words, words

TOP = 20
#: Entries of each part of a list that are its head, and documents of an item that are looked up for its bound.
HEAD, PROBED = 256, 40
#: Documents of a part of a list.
PART = 1 << 16
#: Bytes of terms, or of pairs of items and documents, that are sent to all tasks at most.
BROADCAST = 16 << 20


def _postings(vocabulary: pa.Array | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, at = split_words(batch.column("text"))
            code, terms = coded(found)
            size = np.diff(at)
            doc = np.repeat(np.arange(len(size)), size)
            if vocabulary is not None:
                wanted = pc.is_in(terms, value_set=vocabulary).to_numpy(zero_copy_only=False)[code]
                code, doc = code[wanted], doc[wanted]
            key, times = np.unique(doc * max(1, len(terms)) + code, return_counts=True)
            doc, code = key // max(1, len(terms)), key % max(1, len(terms))
            held = np.flatnonzero(size)  # a row without a term for each document that has any
            doc, times = np.concatenate([doc, held]), np.concatenate([times, np.zeros(len(held), np.int64)])
            term = pa.chunked_array([terms.take(pa.array(code)).cast(pa.binary()), pa.nulls(len(held), pa.binary())]).combine_chunks()
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays([term, batch.column("row").take(at), batch.column("key").take(at), pa.array(times.astype(np.int64)), pa.array(size[doc].astype(np.int64))], ["term", "row", "key", "tf", "n"])

    return run


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """item, term, times: repeated rows of an item count once, and different texts of one item together."""
    told = items.select(F.col(key).alias("item"), F.col(text).alias("text")).where("item IS NOT NULL").distinct()
    return told.select("item", F.explode(words(F.col("text"))).alias("term")).groupBy("item", "term").agg(F.count("*").alias("times"))


def _small(df: DataFrame, size) -> bool:
    return (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST


def lists(docs: DataFrame, asked: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """term, part, row, key, value, w, once, place: the lists of all terms of ``asked``, each part by falling contribution; the
    document gives ``value`` for this term and would give ``w * once`` for any that it holds once."""
    wanted = asked.select("term").distinct()
    few = _small(wanted, F.octet_length("term") + 16)
    vocabulary = wanted.toArrow().column("term").combine_chunks().cast(pa.large_binary()) if few else None
    told = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    held = told.mapInArrow(_postings(vocabulary), "term binary, row long, key long, tf long, n long")
    held = cut(held.withColumn("term", F.col("term").cast("string")), "tput-postings")  # gone once the lists are written
    n, total = held.where("term IS NULL").agg(F.count("*"), F.sum("n")).first()
    often = held.where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df"))
    if not few:
        often = often.join(wanted, "term", "left_semi")
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2) / (2 * F.col("df") + 1))).cast("long")
    often = often.select("term", weight.alias("w"), F.ceil(F.col("df") / PART).cast("int").alias("parts"))
    m = F.lit(75) + F.call_function("div", 25 * F.col("n") * F.lit(n), F.lit(max(1, total or 0)))
    worth = lambda tf: F.call_function("div", 1000000000 * tf, 1000 * tf + 12 * m)
    part = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    entries = held.where("term IS NOT NULL").join(F.broadcast(often) if few else often, "term").select("term", part.alias("part"), "row", "key", (F.col("w") * worth(F.col("tf"))).alias("value"), "w", worth(F.lit(1).cast("long")).alias("once"))
    out = cut(entries.where("value > 0").withColumn("place", F.row_number().over(W.partitionBy("term", "part").orderBy(F.desc("value"), "row"))), "tput-lists", free=True)
    discard(held)
    return out


def exact(entries: DataFrame, asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """item, row, key, score of pairs (item, row) that hold any of the item's terms, by looking them up in the lists."""
    pairs = cut(pairs.select("item", "row"), "tput-pairs", free=True)
    rows = pairs.select("row").distinct()
    few = pairs.count() * 16 <= BROADCAST
    held = entries.select("term", "row", "key", "value").join(F.broadcast(rows) if few else rows, "row", "left_semi")
    met = held.join(F.broadcast(pairs) if few else pairs, "row").join(asked, ["item", "term"])
    return met.groupBy("item", "row", "key").agg(F.sum(F.col("times") * F.col("value")).alias("score"))


def kth(scores: DataFrame, k: int) -> DataFrame:
    """item, bound: the k-th highest score of each item that has as many."""
    ranked = scores.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), "row")))
    return ranked.where(F.col("rank") <= k).groupBy("item").agg(F.min("score").alias("bound"), F.count("*").alias("n")).where(F.col("n") == k).drop("n")


def candidates(entries: DataFrame, asked: DataFrame, k: int = TOP, head: int = HEAD) -> DataFrame:
    """item, row: all documents that can be among an item's ``k`` best, by the first two rounds."""
    heads = entries.where(F.col("place") <= head).join(asked, "term")
    sums = heads.groupBy("item", "row").agg(F.sum(F.col("times") * F.col("value")).alias("score"))
    by = W.partitionBy("item").orderBy(F.desc("score"), "row")
    probed = sums.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= max(k, PROBED))
    bounds = kth(exact(entries, asked, probed), k)

    most = entries.where("place = 1").groupBy("term").agg(F.max("value").alias("most"), F.max("w").alias("w"))
    told = asked.join(most, "term").join(bounds, "item", "left").withColumn("bound", F.coalesce("bound", F.lit(1)))
    # a list's entries are fetched from the threshold on; at least 1, as a score of 0 isn't wanted
    told = told.withColumn("least", F.greatest(F.lit(1), F.ceil(F.col("bound") / F.count("*").over(W.partitionBy("item"))).cast("long")))
    told = cut(told.withColumn("rest", F.least(F.col("least") - 1, F.col("times") * F.col("most"))), "tput-thresholds")
    few = _small(told, F.octet_length("term") + 64)
    rests = told.where("rest > 0").groupBy("item").agg(F.collect_list(F.struct((F.col("times") * F.col("w")).alias("w"), "rest")).alias("rests"))

    deep = told.groupBy("term").agg(F.min(F.ceil(F.col("least") / F.col("times"))).alias("from"))
    deep = entries.join(F.broadcast(deep) if few else deep, "term").where(F.col("value") >= F.col("from")).select("term", "row", "value", "once")
    told = told.select("item", "term", "times", "w", "bound", "least", "rest")
    met = deep.join(F.broadcast(told) if few else told, "term").where(F.col("times") * F.col("value") >= F.col("least"))
    open_ = F.col("times") * F.col("w") * F.col("once") < F.col("least")
    seen = met.groupBy("item", "row").agg(
        F.sum(F.col("times") * F.col("value") - F.when(open_, F.col("rest")).otherwise(0)).alias("sum"), F.first("once").alias("once"), F.first("bound").alias("bound"), F.first("least").alias("least")
    )
    more = F.aggregate("rests", F.lit(0).cast("long"), lambda a, r: a + F.when(r["w"] * F.col("once") < F.col("least"), r["rest"]).otherwise(0))
    seen = seen.join(F.broadcast(rests) if few else rests, "item", "left")
    return seen.where(F.col("sum") + F.coalesce(more, F.lit(0)) >= F.col("bound")).select("item", "row")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, head: int = HEAD, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of highest score above 0 of each item, equal scores by doc_id, nulls last.

    Null and empty texts have no terms and are in no result; items without an id are left out, repeated rows of an item count
    once, and different texts of one item are one item. Each row of ``docs`` is a document of its own, also with an id that
    others have. Empty tables give no rows; other columns are left out.
    """
    asked = cut(item_terms(items, item_key, item_text), "tput-items")
    entries = lists(docs, asked, key, text)
    scored = exact(entries, asked, candidates(entries, asked, k, head))
    by = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key"), "row")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select(F.col("item").alias(item_key), "rank", F.col("key").alias(key), "score")


SEARCH_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, term, any_value(len(w)) AS n, count(*) AS tf FROM (SELECT r, doc_id, w, unnest(w) AS term FROM d) GROUP BY r, doc_id, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
      FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)) GROUP BY item_id, term),
x AS (SELECT item_id, r, doc_id, sum(times * floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * p.n * s.n) // l))))::BIGINT AS score
      FROM i JOIN f USING (term) JOIN p USING (term), s GROUP BY item_id, r, doc_id),
y AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r)::INTEGER AS rank, doc_id, score FROM x WHERE score > 0)
SELECT * FROM y WHERE rank <= {TOP}
"""
