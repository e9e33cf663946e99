"""A stored exact vector index: clusters of unit vectors with centres and radii, of which most are ruled out by the triangle inequality.

The angle between a question and any vector of a cluster is at least the angle to its centre less its radius. The nearest
clusters of each question give it k rows, and the k-th distance is a bound; then only those are read whose least possible distance
doesn't exceed it, or the k-th that the task has found by then. So the result is exact whatever the centres are; they decide only
how much is computed. Which clusters a question visits is settled where they are read, so that no pairs of these are kept.

Centres are the means of a bounded sample. A commit of new vectors adds them to the clusters of the same centres as segments
with radii of their own, and voids the sources that it touches (``siltstone.sources.tables``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.sources import scratch, tables

from .search import DIGITS, POOL, QUESTIONS, ROWS, nearest, nearest_of, packed

#: Vectors that centres are learned from at most, and centres at most.
SAMPLE, CENTRES = 50_000, 2048
#: Rows of a question's nearest clusters that are read first, at least, as a multiple of k.
FIRST = 4
#: Slack of angles, above what rounding of cosines and distances makes.
SLACK = 1e-7
BY = {"vectors": ["cluster"]}


def unit(lists: pa.Array) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Numbers of components of vectors, and for each of these the places of the vectors and their units; null, empty, zero and non-finite ones
    have no place."""
    dim = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    out = {}
    for d in np.unique(dim[dim > 0]):
        at = np.flatnonzero(dim == d)
        x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        norm = np.linalg.norm(x, axis=1)
        good = np.isfinite(norm) & (norm > 0)
        out[int(d)] = at[good], x[good] / norm[good, None]
    return dim, out


def learn(vectors: DataFrame, centres: int | None = None, rounds: int = 8) -> dict[int, np.ndarray]:
    """Centres for each number of components, from at most SAMPLE vectors: those of least hash of their ids."""
    spread = F.xxhash64("id")
    some = vectors.where("embedding IS NOT NULL").orderBy(spread, "id").limit(SAMPLE).select(F.col("embedding").cast("array<double>")).toArrow()
    out = {}
    if not some.num_rows:
        return out
    for dim, (at, x) in unit(some.column("embedding").combine_chunks())[1].items():
        if not len(at):
            continue
        n = min(len(x), centres or min(CENTRES, max(1, int(np.sqrt(len(x))))))
        c = x[np.linspace(0, len(x) - 1, n).astype(int)]
        for _ in range(rounds):
            own = (x @ c.T).argmax(1)
            sums = np.zeros_like(c)
            np.add.at(sums, own, x)
            norm = np.linalg.norm(sums, axis=1)
            c = np.where((norm > 0)[:, None], sums / np.maximum(norm, 1e-300)[:, None], c)
        out[dim] = c
    return out


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def assigned(vectors: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """id, source_url, cluster, angle (to its centre), embedding. A vector of a number of components without centres is cluster -1 - that number, which has no
    centre and is always read."""
    first = {d: i for d, i in zip(sorted(centres), np.cumsum([0] + [len(centres[d]) for d in sorted(centres)]))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, (at, x) in unit(batch.column("embedding"))[1].items():
                if dim in centres:
                    cosine = x @ centres[dim].T
                    cluster, away = cosine.argmax(1) + first[dim], angle(cosine.max(1))
                else:
                    cluster, away = np.full(len(at), -1 - dim), np.zeros(len(at))
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(rows), batch.column("source_url").take(rows), pa.array(cluster.astype(np.int32)), pa.array(away), batch.column("embedding").take(rows)], ["id", "source_url", "cluster", "angle", "embedding"])

    told = vectors.select(F.col("id").cast("long"), F.col("source_url").cast("string"), F.col("embedding").cast("array<double>"))
    return told.mapInArrow(run, "id long, source_url string, cluster int, angle double, embedding array<double>")


def _tables(spark: SparkSession, vectors: DataFrame, centres: dict[int, np.ndarray]) -> dict[str, DataFrame]:
    held = scratch.written(assigned(vectors, centres), "vectors")
    radii = held.groupBy("cluster").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
    return {"vectors": held.drop("angle").repartition("cluster"), "clusters": radii}


def build(spark: SparkSession, root: str, vectors: DataFrame, centres: int | None = None) -> int:
    """An index of vectors (id, source_url, embedding); vectors that are null, empty, zero or not finite are left out."""
    learned = learn(vectors, centres)
    rows = [(i, d, c.tolist()) for i, (d, c) in enumerate((d, c) for d in sorted(learned) for c in learned[d])]
    known = spark.createDataFrame(rows, "cluster int, dim int, centre array<double>")
    return tables.write_tables(spark, root, _tables(spark, vectors, learned) | {"centres": known}, "source_url", BY)


def replace(spark: SparkSession, root: str, vectors: DataFrame, touched: DataFrame) -> int:
    """The state in which the sources of ``touched`` have these vectors and no others. Radii only grow, until the index is built anew."""
    return tables.commit(spark, root, _tables(spark, vectors, centres_of(spark, root)), touched, by=BY)


def centres_of(spark: SparkSession, root: str, number: int | None = None) -> dict[int, np.ndarray]:
    """At most CENTRES for each number of components."""
    out: dict[int, list] = {}
    for r in tables.read_table(spark, root, "centres", number).orderBy("cluster").collect():
        out.setdefault(r["dim"], []).append(r["centre"])
    return {d: np.array(c) for d, c in out.items()}


class Index:
    """One state of an index."""

    def __init__(self, spark: SparkSession, root: str, number: int | None = None):
        held = tables.read_tables(spark, root, ["vectors", "clusters"], number)
        self.vectors, self.centres = held["vectors"], centres_of(spark, root, number)
        told = held["clusters"].groupBy("cluster").agg(F.max("radius").alias("radius"), F.sum("n").alias("n")).collect()  # at most a row for each centre and number of components
        self.radius, self.size = {r["cluster"]: r["radius"] for r in told}, {r["cluster"]: r["n"] for r in told}

    def visits(self, questions: DataFrame, k: int, first_only: bool = False) -> DataFrame:
        """query_id, cluster, least (distance that a vector of the cluster can have), first (whether it is read at once)."""
        centres, radius, size = self.centres, self.radius, self.size
        first = {d: i for d, i in zip(sorted(centres), np.cumsum([0] + [len(centres[d]) for d in sorted(centres)]))}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for dim, (at, q) in unit(batch.column("embedding"))[1].items():
                    if dim in centres:
                        cluster = np.arange(first[dim], first[dim] + len(centres[dim]))
                        away = angle(q @ centres[dim].T)
                        held = np.array([size.get(c, 0) for c in cluster])
                        least = 1 - np.cos(np.maximum(0, away - np.array([radius.get(c, 0.0) for c in cluster]) - SLACK))
                        order = np.argsort(away, axis=1)
                        before = np.cumsum(held[order], axis=1) - held[order]
                        early = np.zeros(away.shape, bool)
                        np.put_along_axis(early, order, before < FIRST * k, axis=1)
                        row, col = np.nonzero((held > 0) & (early | (not first_only)))
                        yield out(batch, at[row], cluster[col], least[row, col], early[row, col])
                    alone = -1 - dim
                    if size.get(alone):
                        n = len(at)
                        yield out(batch, at, np.full(n, alone), np.zeros(n), np.ones(n, bool))

        def out(batch, at, cluster, least, early):
            rows = pa.array(at)
            return pa.RecordBatch.from_arrays([batch.column("query_id").take(rows), pa.array(cluster.astype(np.int32)), pa.array(least), pa.array(early)], ["query_id", "cluster", "least", "first"])

        return questions.select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "query_id long, cluster int, least double, first boolean")

    def within(self, visits: DataFrame, questions: DataFrame, k: int) -> DataFrame:
        """query_id, id, distance: the k nearest in each of the clusters that a question visits."""
        asked = visits.join(questions, "query_id").select("query_id", "cluster", "embedding")
        rows = self.vectors.join(visits.select("cluster").distinct(), "cluster", "left_semi")
        return nearest(rows, asked, k, "cluster").select("query_id", "id", "distance")

    def nearest(self, questions: DataFrame, k: int = POOL) -> DataFrame:
        """query_id, id, distance, rank: as ``search.nearest`` gives over the same vectors."""
        centres = {i: c for i, c in enumerate(c for d in sorted(self.centres) for c in self.centres[d])}
        radius = self.radius

        def reached(cluster: str, q: np.ndarray, bounds: np.ndarray) -> np.ndarray:
            if int(cluster) < 0:
                return np.arange(len(q))
            away = angle(q @ centres[int(cluster)])
            least = 1 - np.cos(np.maximum(0, away - radius.get(int(cluster), 0.0) - SLACK))
            return np.flatnonzero(least <= bounds + 10.0**-DIGITS)

        visits = scratch.written(self.visits(questions, k, first_only=True), "visits")
        found = best_of(self.within(visits, questions, k), k)
        bound = scratch.written(found.where(F.col("rank") == k).select("query_id", F.col("distance").alias("bound")), "bounds")
        asked = packed(questions.join(bound, "query_id", "left"), "query_id", None, QUESTIONS, F.coalesce("bound", F.lit(float("inf"))))
        near = nearest_of(packed(self.vectors, "id", F.col("cluster"), ROWS).drop("bounds"), scratch.written(asked, "asked"), k, ["dim"], reached)
        return near.drop("by")

    def open(self, visits: DataFrame, found: DataFrame, k: int) -> DataFrame:
        """The visits that can still bring a nearer vector than the k-th found, or one as near."""
        bound = found.where(F.col("rank") == k).select("query_id", F.col("distance").alias("bound"))
        return visits.where("NOT first").join(bound, "query_id", "left").where(F.col("bound").isNull() | (F.col("least") <= F.col("bound") + 10.0**-DIGITS))

    def read_share(self, questions: DataFrame, k: int = POOL) -> float:
        """The share of pairs of questions and vectors whose distance is computed."""
        visits = scratch.written(self.visits(questions, k), "visits")
        found = best_of(self.within(visits.where("first"), questions, k), k)
        sizes = questions.sparkSession.createDataFrame(list(self.size.items()), "cluster int, n long")
        n = lambda df: df.join(sizes, "cluster").agg(F.sum("n")).first()[0] or 0
        return (n(visits.where("first")) + n(self.open(visits, found, k))) / max(1, n(visits))


def best_of(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("rank") <= k)
