"""Approximate nearest neighbours by collision counting.

Each of ``m`` random projections is one sorted array of values a block.  A
query's window in an array is centred on the query's own projection and grows
by virtual rehashing: radius r, then r * growth, and so on, reading only what
the wider window adds.  A vector that falls into at least ``threshold`` of the
``m`` windows is verified, i.e. its exact inner product is computed.

A query is done in a block when the radius is so wide that a vector as near as the k-th best
verified one would be in ``threshold`` windows with probability ``SURE``.  The rule looks at the query's
own scores, so it holds for any data: near neighbours end a search early, and where all vectors are
about as far as one another most of a block is verified.

Vectors of any norm are searched: one more coordinate makes all of them as long
as the longest, so the largest inner product is the nearest vector.

Vectors lie in blocks of bounded size; the stated queries meet every block, in
blocks of queries.  No block or query gathers more than its own bounded part,
and the best of all blocks are merged by a ranking per query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch

PROJECTIONS = 64
#: Windows of 64 that must hold a vector before it is verified.
THRESHOLD = 44
#: First radius, for vectors of length 1, and its growth.
RADIUS, GROWTH = 0.4, 1.4
#: Where windows grow by more than this part of the arrays, counting the places of all vectors is quicker.
WIDE = 20
#: Chance that a vector as near as the k-th best one is verified.
SURE = 0.85
#: More than inner products of vectors of length 1 differ by in single precision.
SINGLE = np.float32(1e-5)
BLOCK, QUERY_BLOCK = 32768, 2048
SEED = 11


def reach(projections: int = PROJECTIONS, threshold: int = THRESHOLD, sure: float = SURE) -> float:
    """Radius over distance at which a vector is in ``threshold`` windows with probability ``sure``.

    A vector at distance d is in a window of radius r with p = P(|N(0, d)| <= r), in all windows alike.
    """
    def chance(ratio: float) -> float:
        p = math.erf(ratio / math.sqrt(2))
        return sum(math.comb(projections, i) * p**i * (1 - p) ** (projections - i) for i in range(threshold, projections + 1))

    lo, hi = 0.0, 10.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chance(mid) < sure else (lo, mid)
    return hi


def usable(vector) -> F.Column:
    """Not null, no null or non-finite component, not zero, not empty."""
    big = float(np.finfo(np.float64).max)
    return (vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= big))
            & F.exists(vector, lambda x: x != 0))


def axes(size: int) -> np.ndarray:
    """Random projections, a column each: normal components, but directions at right angles as far as ``size`` allows.

    Each projection alone is a normal one; together their counts scatter less than those of independent ones.
    """
    rng, found = np.random.default_rng(SEED), []
    while sum(a.shape[1] for a in found) < PROJECTIONS:
        basis, _ = np.linalg.qr(rng.standard_normal((size, size)))
        found.append(basis * np.sqrt(rng.chisquare(size, size)))
    return np.concatenate(found, axis=1)[:, :PROJECTIONS]


class Index:
    """Sorted arrays of one block of vectors, ``longest`` being the greatest length of all blocks over ``scale``."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, scale: float, longest: float):
        self.ids, self.vectors = ids, vectors
        # Divided twice, as the product of both can be too small or large for a number.
        unit = vectors / scale / longest
        rest = np.sqrt(np.maximum(1 - (unit**2).sum(axis=1), 0))
        self.axes = axes(vectors.shape[1] + 1)
        values = np.column_stack([unit, rest]) @ self.axes
        self.unit = unit.astype(np.float32)
        order = np.argsort(values, axis=0).T
        values = np.take_along_axis(values.T, order, axis=1)
        # All arrays in one: that of projection i starts at i * step.
        self.step = 4 * float(np.abs(self.axes).sum(axis=0).max()) + 1
        self.starts = np.arange(PROJECTIONS) * self.step
        self.values = (values + self.starts[:, None]).ravel()
        self.order = order.astype(np.int64).ravel()
        # Where each vector stands in each array, and so whether a window holds it.
        small = np.uint16 if len(ids) < 2**16 else np.uint32
        self.place = np.empty((PROJECTIONS, len(ids)), small)
        np.put_along_axis(self.place, order, np.arange(len(ids), dtype=small)[None, :], axis=1)
        self.ahead, self.inside = np.empty_like(self.place), np.empty(self.place.shape, bool)
        self.reach = reach()

    def _count(self, hits, first, a, lo, hi, b) -> np.ndarray:
        """How many windows hold each vector, as they grow from lo:hi to a:b."""
        if (lo - a).sum() + (b - hi).sum() > len(self.values) / WIDE:
            kind = self.place.dtype.type
            np.subtract(self.place, (a - first).astype(kind)[:, None], out=self.ahead)
            np.less(self.ahead, (b - a).astype(kind)[:, None], out=self.inside)
            return np.add.reduce(self.inside.view(np.uint8), axis=0, dtype=np.uint8)
        edges = zip([*a.tolist(), *hi.tolist()], [*lo.tolist(), *b.tolist()], strict=True)
        return hits + np.bincount(np.concatenate([self.order[i:j] for i, j in edges]), minlength=len(hits)).astype(np.uint8)

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(scores, ids) of the k best verified vectors, nearest first, ties to the smaller id, and how many were verified."""
        n = len(self.ids)
        unit = query / np.abs(query).max()
        unit = unit / np.sqrt(unit @ unit)
        centre = np.append(unit, 0.0) @ self.axes + self.starts
        first, end = np.arange(PROJECTIONS) * n, np.arange(1, PROJECTIONS + 1) * n
        lo = hi = np.clip(np.searchsorted(self.values, centre), first, end)
        hits, new = np.zeros(n, np.uint8), np.ones(n, bool)
        found, near, radius = np.zeros(0, np.int64), np.zeros(0, np.float32), RADIUS
        short = unit.astype(np.float32)
        while new.any():
            a = np.minimum(np.maximum(np.searchsorted(self.values, centre - radius), first), lo)
            b = np.maximum(np.minimum(np.searchsorted(self.values, centre + radius, "right"), end), hi)
            hits = self._count(hits, first, a, lo, hi, b)
            lo, hi = a, b
            fresh = np.flatnonzero((hits >= THRESHOLD) & new)
            new[fresh] = False
            fresh = fresh[self.ids[fresh] != own]
            found, near = np.append(found, fresh), np.append(near, self.unit[fresh] @ short)
            radius, last = radius * GROWTH, radius
            if len(near) >= k:
                kth = -np.partition(-near, k - 1)[k - 1]
                keep = near >= kth - SINGLE  # whoever may be among the best when counted exactly
                found, near = found[keep], near[keep]
                enough = self.reach * math.sqrt(max(0.0, 2 - 2 * float(kth)))
                if last >= enough:
                    break
                radius = min(radius, enough)
        with np.errstate(over="ignore", invalid="ignore"):  # sums of huge components are infinite
            scores = np.einsum("ij,j->i", self.vectors[found], query)
        ids = self.ids[found]
        best = np.lexsort((ids, -scores))[:k]
        return scores[best], ids[best], n - int(new.sum())


def _pack(vectors: pa.ChunkedArray) -> np.ndarray:
    return vectors.combine_chunks().flatten().to_numpy().reshape(len(vectors), -1)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, nearest first.

    Nearness is the inner product in double precision, ties go to the smaller
    key.  Vectors that are null, zero, or hold null or non-finite components
    take no part, nor do those whose number of components is not the commonest one.  Rows
    that repeat a key are candidates each, but never of a query with that key.
    A null key takes no part.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    pick = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    good = pick(vectors).where(F.col("id").isNotNull() & usable(F.col("v")))
    width = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, vec_id long, score double"
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    good = good.where(F.size("v") == width[0])
    # Lengths are taken of vectors over their largest component, so that no square is too small or large.
    scale = float(good.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0])
    longest = float(good.agg(F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(x / F.lit(scale), 2))))).first()[0])
    n_blocks = -(-width[1] // BLOCK)
    asked = pick(queries).where(F.col("id").isNotNull() & usable(F.col("v")) & (F.size("v") == width[0])).dropDuplicates(["id"])
    n_asked = asked.count()
    query_blocks = max(1, -(-n_asked // QUERY_BLOCK))
    # Rows that repeat an id are spread as well.
    held = good.withColumn("block", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int"))
    sent = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int"))
    # A block of vectors goes to each block of queries, and the other way round.
    left = held.select("id", "v", "block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("part"))
    right = sent.select("id", "v", "part", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))

    def meet(candidates: pa.Table, questions: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if candidates.num_rows and questions.num_rows:
            table = candidates.sort_by("id")
            index = Index(table["id"].to_numpy(), _pack(table["v"]), scale, longest)
            for own, v in zip(questions["id"].to_pylist(), _pack(questions["v"]), strict=True):
                scores, ids, _ = index.search(v, own, k)
                out.append((np.full(len(ids), own), ids, scores))
        q, i, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64())})

    found = scratch.table(left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(meet, schema), "found")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))
