"""Near-duplicate vectors by spherical-cap filters.

Filter directions are structured: several random rotations, and after each a product code. A unit vector is cut into
blocks, each block has random code words, and a filter is one word for each block. The sum of the blocks' inner products
with their words is the vector's height along the filter; list decoding finds all filters whose height exceeds a bound.
The bound is set for each number of components from made pairs at the least cosine, so that all but MISSED of them share
a filter; pairs that are closer share more. Where there are few components fewer and wider caps do.

Vectors are joined on filters as half-precision copies, whose products are wrong by less than BAND; pairs within BAND of
the least cosine are computed again in double precision. A pair counts in the least filter that both vectors have, so
that a task adds up links for each vector and passes on one row for a vector of a group, not one for each pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, salted_join
from .components import components

BLOCKS = 2
#: (codes, words of each block) to choose from.
SHAPES = [(2, 2), (4, 2), (4, 4), (8, 4), (8, 8), (16, 8), (16, 16), (24, 28)]
#: Share of pairs at the least cosine that may have no filter in common, by PAIRS made ones.
MISSED, PAIRS = 0.002, 2000
#: Filters of a vector, on average, at most.
MOST = 40
#: Components up to which codes are rotated; longer vectors have their components shuffled and some negated.
ROTATED = 128
BAND = 2.0**-9
#: Vectors of one filter that a task compares with each other at once; more are cut into as many groups as needed,
#: and each pair of groups is a task's work of its own.
GROUP = 512
#: Rows of one vector that a task gives their result.
SAME = 1 << 14


def code(dim: int, words: int, seed: int = 0) -> tuple[np.ndarray | None, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(rotation or None, order and signs of components, code words of each block)."""
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0] if dim <= ROTATED else None
    order, signs = rng.permutation(dim), rng.choice([-1.0, 1.0], dim)
    out = []
    for part in np.array_split(np.arange(dim), min(BLOCKS, dim)):
        w = rng.standard_normal((words, len(part)))
        out.append(w / np.linalg.norm(w, axis=1, keepdims=True) * math.sqrt(len(part) / dim))
    return rotation, order, signs, out


def gains(x: np.ndarray, one: tuple) -> list[np.ndarray]:
    """Inner products of the rows' blocks with each block's code words."""
    rotation, order, signs, words = one
    y = x @ rotation if rotation is not None else x[:, order] * signs
    ends = np.cumsum([w.shape[1] for w in words])[:-1]
    return [part @ w.T for part, w in zip(np.split(y, ends, axis=1), words)]


@cache
def filters(dim: int, least: float) -> tuple[list[tuple], float]:
    """(codes, bound of height) for vectors of ``dim`` components; the same wherever it is computed.

    Of the shapes whose bound, set so that made pairs at the least cosine share a filter, leaves a vector MOST filters or
    fewer, the one that compares the fewest pairs.
    """
    rng = np.random.default_rng(dim)
    x, z = (unit(rng.standard_normal((PAIRS, dim))) for _ in range(2))
    if dim > 1:
        z = unit(z - (z * x).sum(axis=1, keepdims=True) * x)
        z = least * x + math.sqrt(1 - least * least) * z
    else:
        z = x
    best = None
    for codes, words in SHAPES if dim < 32 else SHAPES[-1:]:
        made = [code(dim, words, k) for k in range(codes)]
        met, sample = np.full(PAIRS, -np.inf), []
        for one in made:
            height = [sum(g.reshape(PAIRS, *[-1 if i == k else 1 for i in range(len(gs))]) for k, g in enumerate(gs)).reshape(PAIRS, -1) for gs in (gains(x, one), gains(z, one))]
            met = np.maximum(met, np.minimum(*height).max(axis=1))
            sample.append(height[0])
        bound = float(np.quantile(met, MISSED)) - 1e-9
        each = [(h > bound).mean(axis=0) for h in sample]  # how full each filter is
        mine, pairs = sum(e.sum() for e in each), sum((e * e).sum() for e in each)
        if best is None or (mine > MOST, pairs) < best[:2]:
            best = (mine > MOST, pairs, made, bound)
    return best[2], best[3]


def decode(x: np.ndarray, one: tuple, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) for every filter whose height for the row's unit vector exceeds ``bound``.

    Blocks are taken in turn: a beginning stays on the list while the best words of the blocks to come could lift it
    above the bound.
    """
    blocks = gains(x, one)
    hope = np.cumsum([g.max(axis=1) for g in blocks[::-1]], axis=0)[::-1]
    row, name, height = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
    for k, g in enumerate(blocks):
        rest = hope[k + 1] if k + 1 < len(blocks) else np.zeros(len(x))
        at, word = np.nonzero(height[:, None] + g[row] > (bound - rest[row])[:, None])
        height = height[at] + g[row[at], word]
        row, name = row[at], name[at] * g.shape[1] + word
    return row, name


def usable(x: Column) -> Column:
    """Whether a vector can link: it is not null, empty or zero, and has no null or non-finite component."""
    good = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    return F.coalesce(good, F.lit(False))


def link(vectors: DataFrame, least: float = 0.9, key: str = "vec_id", column: str = "embedding", group: int = GROUP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, degrees, edges) of the vectors of ``vectors``.

    classes: __rep, members (how many rows hold exactly this vector), __x (its doubles). degrees: __rep, others (how many
    rows' vectors, other than this one, have a cosine of ``least`` or more with it). edges: a, b, whose connected
    components are those of all such pairs. A vector that is null, empty, zero, or holds null or non-finite components is in
    none. Vectors of different lengths link with none of each other. Shared filters find all but MISSED of the pairs at
    ``least`` itself, and more of those above.
    """
    x = F.col(column).cast("array<double>")
    rows = vectors.select(F.col(key).alias("__id"), x.alias("__x")).where(F.col("__id").isNotNull() & usable(F.col("__x")))
    classes = cut(rows.groupBy("__x").agg(F.min("__id").alias("__rep"), F.count("*").alias("members")), "vectors")

    def caps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.list_value_length(batch.column("__x")).to_numpy(zero_copy_only=False)
            for dim in np.unique(size):
                part = batch.filter(pa.array(size == dim))
                codes, bound = filters(int(dim), least)
                for i in range(0, part.num_rows, 512):
                    some = part.slice(i, 512)
                    x = unit(some.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                    found = [decode(x, one, bound) for one in codes]
                    row = np.concatenate([at for at, _ in found])
                    name = np.concatenate([(name * len(codes) + k) for k, (_, name) in enumerate(found)])
                    order = np.lexsort((name, row))
                    row, name = row[order], name[order]
                    edge = np.searchsorted(row, np.arange(len(x) + 1))
                    own = pa.array([name[a:b].astype(np.int32).tobytes() for a, b in zip(edge, edge[1:])], pa.binary())
                    half = pa.array([v.tobytes() for v in x.astype(np.float16)], pa.binary())
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(name << 20 | int(dim), pa.int64()), *(c.take(take) for c in (some.column("__rep"), some.column("members"), half, own))], ["cap", "__rep", "members", "__x", "own"])

    kind = classes.schema["__rep"].dataType.simpleString()
    held = cut(classes.mapInArrow(caps, f"cap long, __rep {kind}, members long, __x binary, own binary"), "caps")
    sizes = held.groupBy("cap").agg(F.count("*").alias("size")).where("size > 1")
    parts = F.ceil(F.col("size") / group).cast("int")
    sized = held.join(sizes.select("cap", parts.alias("parts")), "cap").withColumn("part", F.pmod(F.xxhash64("__rep"), F.col("parts")).cast("int"))
    # pairs of groups: (i, j) for i <= j, each holding both groups
    mate = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = sized.select("*", mate.alias("mate")).select("cap", F.least("part", "mate").alias("i"), F.greatest("part", "mate").alias("j"), "part", "__rep", "members", "__x", "own")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Runs of rows with one (cap, i, j); a run may go on in the next batch."""
        held = None
        for frame in batches:
            frame = frame if held is None else pd.concat([held, frame])
            last = frame.iloc[-1][["cap", "i", "j"]]
            ended = ~((frame.cap == last.cap) & (frame.i == last.i) & (frame.j == last.j))
            held = frame[~ended]
            yield from told(frame[ended])
        if held is not None:
            yield from told(held)

    def told(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """others of a, or an edge from a to b, or a pair a, b to be computed again."""
        out: list[pd.DataFrame] = []
        if len(frame):
            cap, i, j, part, rep, members = (frame[c].to_numpy() for c in ("cap", "i", "j", "part", "__rep", "members"))
            x, own = frame["__x"].to_numpy(), frame["own"].to_numpy()
            edge = np.flatnonzero(np.diff(cap) | np.diff(i) | np.diff(j)) + 1
            for a, b in zip([0, *edge], [*edge, len(frame)]):
                left = np.arange(a, b) if i[a] == j[a] else a + np.flatnonzero(part[a:b] == i[a])
                right = left if i[a] == j[a] else a + np.flatnonzero(part[a:b] == j[a])
                u, v = (np.frombuffer(b"".join(x[side]), np.float16).reshape(len(side), -1).astype(np.float32) for side in (left, right))
                cosine = u @ v.T
                found = (cosine >= least - BAND) & (rep[left][:, None] != rep[right][None, :])
                if not found.any():
                    continue
                found &= ~met_before(own[left], own[right], cap[a] >> 20)
                near = found & (cosine < least + BAND)
                sure = found & ~near
                s, t = np.nonzero(np.triu(near) if i[a] == j[a] else near)
                if len(s):
                    out.append(pd.DataFrame({"a": rep[left[s]], "b": rep[right[t]], "others": pd.array([None] * len(s), "Int64")}))
                if sure.any():
                    sums = np.concatenate([sure @ members[right], sure.T @ members[left] if i[a] != j[a] else np.zeros(0, np.int64)])
                    both = np.concatenate([rep[left], rep[right] if i[a] != j[a] else rep[:0]])
                    first = least_linked(sure, rep[left], rep[right], i[a] == j[a])
                    some = sums > 0
                    out.append(pd.DataFrame({"a": both[some], "b": first[some], "others": pd.array(sums[some], "Int64")}))
        if out:
            yield pd.concat(out)

    found = cut(dealt.repartition("cap", "i", "j").sortWithinPartitions("cap", "i", "j").mapInPandas(verify, f"a {kind}, b {kind}, others long"), "vector-links")
    end = lambda c: classes.select(F.col("__rep").alias(c), F.col("__x").alias(f"__{c}"), F.col("members").alias(f"members_{c}"))
    again = found.where("others is null").join(end("a"), "a").join(end("b"), "b")
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda p, q: p + q)
    scaled = lambda c: F.transform(c, lambda v: v / F.array_max(F.transform(c, F.abs)))
    again = again.withColumns({"__a": scaled("__a"), "__b": scaled("__b")})
    cosine = dot("__a", "__b") / (F.sqrt(dot("__a", "__a")) * F.sqrt(dot("__b", "__b")))
    again = cut(again.where(cosine >= least).select("a", "b", "members_a", "members_b"), "vector-pairs")
    degrees = found.where("others is not null").select(F.col("a").alias("__rep"), "others")
    degrees = degrees.unionByName(again.select(F.col("a").alias("__rep"), F.col("members_b").alias("others"))).unionByName(again.select(F.col("b").alias("__rep"), F.col("members_a").alias("others")))
    edges = found.where("others is not null").select("a", "b").unionByName(again.select("a", "b"))
    return classes, degrees.groupBy("__rep").agg(F.sum("others").alias("others")), edges


def met_before(left: np.ndarray, right: np.ndarray, here: int) -> np.ndarray:
    """Which pairs of a row of ``left`` and one of ``right`` share a filter before ``here``; rows are bytes of their filters."""
    lists = [[np.frombuffer(v, np.int32) for v in side] for side in (left, right)]
    row = [np.repeat(np.arange(len(side)), [len(v) for v in side]) for side in lists]
    name = [np.concatenate(side) for side in lists]
    shared = np.intersect1d(*(n[n < here] for n in name))
    if not len(shared):
        return np.zeros((len(left), len(right)), bool)
    table = []
    for side, r, n in zip(lists, row, name):
        some = np.isin(n, shared)
        holds = np.zeros((len(side), len(shared)), np.float32)
        holds[r[some], np.searchsorted(shared, n[some])] = 1
        table.append(holds)
    return table[0] @ table[1].T > 0


def least_linked(linked: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool) -> np.ndarray:
    """The least name that each row, and after them each column if they aren't the rows, reaches by links."""
    a, b = left.copy(), right.copy()
    rank = np.unique(np.concatenate([left, right]))
    x, y = np.searchsorted(rank, a), np.searchsorted(rank, b)
    none = len(rank)
    while True:
        to = np.minimum(x, np.where(linked, y[None, :], none).min(axis=1))
        back = to if same else np.minimum(y, np.where(linked, to[:, None], none).min(axis=0))
        if (to == x).all() and (back == y).all():
            return rank[x] if same else rank[np.concatenate([x, y])]
        x, y = to, back


def unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def near_vectors(vectors: DataFrame, least: float = 0.9, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """A row for each row of ``vectors``: key, n_links, component_id, kept.

    n_links counts the other rows linked with the row's vector, equal vectors among them. A vector that links with
    nothing is its own component. A null key links with nothing and has a null component. Rows that share a key
    count each as a vector and have one component. Other columns are left out.
    """
    classes, degrees, edges = link(vectors, least, key, column)
    groups = components(edges).select(F.col("node").alias("__rep"), "component")
    told = classes.join(degrees, "__rep", "left").join(groups, "__rep", "left")
    told = told.select("__x", (F.coalesce("others", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("component", "__rep").alias("component"))
    rows = vectors.select(F.col(key).alias("__id"), F.col(column).cast("array<double>").alias("__x"))
    linked = F.col("__id").isNotNull() & usable(F.col("__x"))
    # a vector that very many rows hold is dealt out; what can't link isn't joined
    out = salted_join(rows.where(linked), told, "__x", "__id", SAME).select("__id", "n_links", "component")
    alone = rows.where(~linked).select("__id", F.lit(0).cast("long").alias("n_links"), F.col("__id").alias("component"))
    out = out.unionByName(alone)
    return out.select(F.col("__id").alias(key), "n_links", F.col("component").alias("component_id"), (F.col("__id") == F.col("component")).alias("kept"))


#: The same by all pairs. Fixed value: the least cosine.
NEAR_SQL = """
WITH RECURSIVE g AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE CASE WHEN len(a.x) = len(b.x) THEN list_cosine_similarity(a.x, b.x) END >= 0.9),
r AS (SELECT a AS one, b AS other FROM l UNION SELECT r.one, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT one, min(other) AS least_id FROM r GROUP BY one),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(least_id, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least_id, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.one = vec_id
"""
