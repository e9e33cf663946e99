"""A stored inverted index of chunks: postings by lexeme, changed by segments, and the best rows of a batch of questions.

A posting is a lexeme of a row with the numbers of its places in heading (a) and content (b); its impact is 5a + 2b, as a place in
the heading counts 1 and one in the content 0.4. The corpus is dealt out by rows: a task sorts the postings of a part of its rows by
lexeme, so that nothing is shuffled to build an index. Within a part those of a lexeme stand by falling impact in blocks, each of
which knows its highest impact. A batch reads the pages of Parquet that hold its own lexemes and no text.

Any lexeme of a question will do, so a row's score is the sum of its impacts. ``Lists.rank`` deals the entries of a batch out by
rows, and a task sums them for all questions and keeps its k best of each (``search.by_documents``). ``candidates`` finds, for few
questions over long lists, the rows that can be among the k best:

1. The first blocks of the question's lexemes are summed, and the rows of the highest sums looked up in all its lists: the
   k-th highest score is a bound that the wanted rows reach.
2. Lists whose highest impacts all together stay below the bound can't bring a row in by themselves. Of the others only blocks are
   read whose highest impact reaches the bound with the highest of all other lists. Rows whose impacts seen, with
   what other lists may add, stay below the bound go.
3. The rest are looked up in all lists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from siltstone.functions import parse
from siltstone.sources import scratch, tables

from .search import BODY, BROADCAST, HEAD, POOL, STOP_WORDS, by_documents, flat, pieces, words

#: Postings of a block; rows of a question that are looked up for its bound; postings that a task sorts at once; different runs whose lexemes a
#: task remembers; lexemes of a batch that are looked for by pages.
BLOCK, PROBED, PART, KNOWN, SOUGHT = 128, 40, 1 << 18, 1 << 18, 1000
BY: dict[str, list[str]] = {}


def simple() -> Callable[[list[str]], list[list[str]]]:
    """The lexemes of different words: themselves, function words left out."""
    stop = frozenset(STOP_WORDS)
    return lambda found: [[] if w in stop else [w] for w in found]


def english() -> Callable[[list[str]], list[list[str]]]:
    """The lexemes of different runs without white space: stems and typed tokens. A run is parsed once for each time that it is forgotten."""
    stop, known = frozenset(STOP_WORDS), {}

    def lexemes(found: list[str]) -> list[list[str]]:
        if len(known) > KNOWN:
            known.clear()
        for r in found:
            if r not in known:
                known[r] = [x for k, t in parse.tokens_of(r) if (x := parse.lexeme(k, t, stop)) is not None]
        return [known[r] for r in found]

    return lexemes


#: For each analyzer what cuts a text, and what gives the lexemes of different pieces.
ANALYZERS = {"simple": (words, simple), "english": (parse.runs, english)}


def counted(rows: DataFrame, analyzer: str, arranged: Callable[[list[pa.Table]], Iterator[pa.RecordBatch]] | None = None, more: tuple[StructField, ...] = ()) -> DataFrame:
    """lexeme, source_url, id, a, b: the lexemes of each row (id, source_url, heading, content) with their numbers of places. ``arranged``: what becomes of
    parts of them, which gives the columns ``more`` besides."""
    cut, lexemes = ANALYZERS[analyzer]
    told = rows.select("source_url", "id", cut(F.col("heading")).alias("a"), cut(F.col("content")).alias("b"))
    schema = StructType([StructField("lexeme", StringType()), told.schema["source_url"], told.schema["id"], StructField("a", IntegerType()), StructField("b", IntegerType()), *more])

    def of(batch: pa.RecordBatch, lexemes) -> pa.Table:
        (a, at), (b, below) = (flat(batch.column(c)) for c in "ab")
        found = pa.concat_arrays([a, b]).dictionary_encode()
        own = lexemes(found.dictionary.to_pylist())
        size = np.array([len(x) for x in own], np.int64)
        names = pa.array([x for y in own for x in y], pa.string()).dictionary_encode()
        piece = found.indices.to_numpy(zero_copy_only=False)
        n = size[piece]
        row, side = np.repeat(np.concatenate([at, below]), n), np.repeat(np.repeat([0, 1], [len(at), len(below)]), n)
        first = np.append(0, np.cumsum(size))[piece]
        code = names.indices.to_numpy(zero_copy_only=False)[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        key, times = np.unique((row * np.int64(max(1, len(names.dictionary))) + code) * 2 + side, return_counts=True)
        begins = np.flatnonzero(np.append(True, key[1:] >> 1 != key[:-1] >> 1)) if len(key) else np.zeros(0, np.int64)
        sums = [np.add.reduceat(np.where(key & 1 == i, times, 0), begins) if len(key) else times for i in (0, 1)]
        row, code = np.divmod(key[begins] >> 1, max(1, len(names.dictionary)))
        rows = pa.array(row)
        columns = [names.dictionary.take(pa.array(code)), batch.column("source_url").take(rows), batch.column("id").take(rows), *(pa.array(x.astype(np.int32)) for x in sums)]
        return pa.table(columns, schema.names[:5])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = [], lexemes()
        for batch in pieces(batches):
            held.append(of(batch, known))
            if not arranged or sum(t.num_rows for t in held) >= PART:
                yield from arranged(held) if arranged else held[0].to_batches()
                held = []
        if held and arranged:
            yield from arranged(held)
        held = batch = None
        pa.default_memory_pool().release_unused()  # else it stays with the worker through all later stages

    return told.mapInArrow(run, schema)


def arranged(block: int) -> Callable[[list[pa.Table]], Iterator[pa.RecordBatch]]:
    """Postings as they are stored, by lexeme and falling impact, with impact, block and the block's highest impact."""

    def run(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        rows = pa.concat_tables(held).select(["lexeme", "source_url", "id", "a", "b"]).combine_chunks()
        if not rows.num_rows:
            return
        names = rows.column("lexeme").combine_chunks().dictionary_encode()
        rank = np.empty(len(names.dictionary), np.int64)
        rank[pc.sort_indices(names.dictionary).to_numpy()] = np.arange(len(rank))
        rank = rank[names.indices.to_numpy(zero_copy_only=False)]
        impact = HEAD * rows.column("a").to_numpy() + BODY * rows.column("b").to_numpy()
        order = np.lexsort((-impact, rank))
        rank, impact = rank[order], impact[order].astype(np.int32)
        place = np.arange(len(rank)) - np.searchsorted(rank, rank)
        rows = rows.take(pa.array(order))
        for name, x in (("impact", impact), ("block", (place // block).astype(np.int32)), ("most", impact[np.arange(len(rank)) - place % block])):
            rows = rows.append_column(name, pa.array(x))
        yield from rows.combine_chunks().to_batches(max_chunksize=1 << 16)

    return run


STORED = tuple(StructField(c, IntegerType()) for c in ("impact", "block", "most"))


def postings(rows: DataFrame, analyzer: str = "simple") -> DataFrame:
    """Stored postings of rows (id, source_url, heading, content); null texts have none."""
    return counted(rows, analyzer, arranged(BLOCK), STORED)


def merged(held: DataFrame) -> DataFrame:
    """Postings of several segments, arranged anew."""
    block = arranged(BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n = [], 0
        for batch in batches:
            rows.append(pa.Table.from_batches([batch]))
            n += batch.num_rows
            if n >= PART:
                yield from block(rows)
                rows, n = [], 0
        if rows:
            yield from block(rows)

    return held.mapInArrow(run, held.schema)


def about(spark: SparkSession, analyzer: str = "simple") -> DataFrame:
    """The row that an index says of itself."""
    return spark.createDataFrame([(analyzer,)], "analyzer string")


def analyzer_of(spark: SparkSession, root: str, number: int | None = None) -> str:
    return tables.read_table(spark, root, "about", number).first()[0]


def build(spark: SparkSession, root: str, rows: DataFrame, analyzer: str = "simple") -> int:
    """The first state of an index of ``rows``, or one that replaces all."""
    return tables.write_tables(spark, root, {"postings": postings(rows, analyzer), "about": about(spark, analyzer)}, "source_url", BY)


def replace(spark: SparkSession, root: str, rows: DataFrame, touched: DataFrame, more: dict[str, DataFrame] | None = None) -> int:
    """The state in which the sources of ``touched`` have the postings of ``rows`` and no others; ``more``: other tables' rows of these sources."""
    return tables.commit(spark, root, {"postings": postings(rows, analyzer_of(spark, root))} | (more or {}), touched, by=BY)


def merge(spark: SparkSession, root: str) -> int | None:
    """All segments as one, without void rows, in blocks over parts of all of them."""
    return tables.merge(spark, root, {"postings": merged}, BY)


class Lists:
    """The lists of one batch of questions (query_id, text): only buckets of its lexemes are read."""

    def __init__(self, spark: SparkSession, root: str, questions: DataFrame, number: int | None = None):
        texts = questions.select(F.col("query_id").alias("id"), F.lit("").alias("source_url"), F.col("text").alias("heading"), F.lit(None).cast("string").alias("content"))
        self.asked = scratch.written(counted(texts, analyzer_of(spark, root, number)).select(F.col("id").alias("query_id"), "lexeme").distinct(), "lexemes")
        wanted = self.asked.select("lexeme").distinct()
        size, n = wanted.agg(F.sum(F.octet_length("lexeme") + 16), F.count("*")).first()
        self.few = (size or 0) <= BROADCAST
        held = tables.read_table(spark, root, "postings", number)
        if n <= SOUGHT:  # pages that hold none of them aren't read
            held = held.where(F.col("lexeme").isin([r[0] for r in wanted.collect()] or [""]))
        self.postings, self.entries = held, held.join(self.small(wanted), "lexeme", "left_semi")

    def small(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.few else df

    def looked_up(self, pairs: DataFrame) -> DataFrame:
        """query_id, id, a, b, impact: sums over all lists of the question, of each pair (query_id, id)."""
        pairs = scratch.written(pairs.select("query_id", "id"), "pairs")
        some = pairs.count() * 16 <= BROADCAST
        near = lambda df: F.broadcast(df) if some else df
        held = self.entries.join(near(pairs.select("id").distinct()), "id", "left_semi")
        met = held.join(near(pairs), "id").join(self.small(self.asked), ["query_id", "lexeme"])
        return met.groupBy("query_id", "id").agg(*(F.sum(c).alias(c) for c in ("a", "b", "impact")))

    def bounds(self, k: int) -> DataFrame:
        """query_id, lexeme, most (the list's highest impact), others (of the other lists together), bound, from (least impact that is read; null for lists
        that can't bring a row in)."""
        first = self.entries.where("block = 0").join(self.small(self.asked), "lexeme")
        most = first.groupBy("query_id", "lexeme").agg(F.max("most").alias("most"))
        best = lambda c: W.partitionBy("query_id").orderBy(F.desc(c), "id")
        sums = first.groupBy("query_id", "id").agg(F.sum("impact").alias("sum"))
        probed = sums.withColumn("rank", F.row_number().over(best("sum"))).where(F.col("rank") <= max(k, PROBED))
        scored = self.looked_up(probed).withColumn("rank", F.row_number().over(best("impact"))).where(F.col("rank") <= k)
        bound = scored.groupBy("query_id").agg(F.min("impact").alias("bound"), F.count("*").alias("n")).where(F.col("n") == k).drop("n")
        told = most.join(bound, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(0)))
        lists = W.partitionBy("query_id")
        upto = lists.orderBy("most", "lexeme").rowsBetween(W.unboundedPreceding, 0)
        told = told.withColumns({"others": F.sum("most").over(lists) - F.col("most"), "upto": F.sum("most").over(upto)})
        return scratch.written(told.withColumn("from", F.when(F.col("upto") >= F.col("bound"), F.greatest(F.lit(0), F.col("bound") - F.col("others")))), "bounds")

    def candidates(self, k: int) -> DataFrame:
        """query_id, id: rows that can be among the k best of a question."""
        told = self.bounds(k)
        # what a list may still add to a row that it hasn't given
        told = told.withColumn("rest", F.least("most", F.coalesce("from", "most"))).withColumn("rests", F.sum("rest").over(W.partitionBy("query_id")))
        read = told.where("from IS NOT NULL").select("query_id", "lexeme", "from", "bound", "rest", "rests")
        deep = self.entries.join(self.small(read.groupBy("lexeme").agg(F.min("from").alias("least"))), "lexeme").where("most >= least").drop("least")
        met = deep.join(self.small(read), "lexeme").where(F.col("impact") >= F.col("from"))
        seen = met.groupBy("query_id", "id").agg(F.sum(F.col("impact") - F.col("rest")).alias("more"), F.first("rests").alias("rests"), F.first("bound").alias("bound"))
        return seen.where(F.col("more") + F.col("rests") >= F.col("bound")).select("query_id", "id")

    def coded(self, lexemes: pa.Array, spark: SparkSession) -> DataFrame:
        """id, code, impact of all postings of these lexemes; code is a lexeme's place."""
        codes = spark.createDataFrame(pa.table([lexemes, pa.array(np.arange(len(lexemes), dtype=np.int32))], ["lexeme", "code"]))
        return self.postings.join(F.broadcast(codes), "lexeme").select(F.col("id").cast("long").alias("id"), "code", F.col("impact").cast("long").alias("impact"))

    def rank(self, k: int = POOL, direct: int = 1) -> DataFrame:
        """query_id, id, score, rank. ``direct`` 0: only candidates are looked up."""
        if direct:
            return by_documents(self.asked, self.coded, k)
        scored = self.looked_up(self.candidates(k)).select("query_id", "id", F.round(F.col("a") * 1.0 + F.col("b") * 0.4, 6).alias("score"), "impact")
        order = W.partitionBy("query_id").orderBy(F.desc("impact"), "id")
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("impact")


def rank(spark: SparkSession, root: str, questions: DataFrame, k: int = POOL, number: int | None = None, direct: int = 1) -> DataFrame:
    """query_id, id, score, rank: the k best rows of the index for each question (query_id, text), ties by id; a question without lexemes
    matches nothing. ``direct`` 0: by rounds of bounded reads, which pay for few questions over long lists."""
    return Lists(spark, root, questions, number).rank(k, direct)
