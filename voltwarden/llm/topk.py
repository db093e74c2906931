"""Exact top-k search by inner product with a Voronoi partition.

Pivots split all vectors into cells. A cell's summary is its pivot, how many vectors it has, the least and largest
distance of one from the pivot, and the largest norm; these bound every score in it. Queries are grouped by their own
cells: scored in the nearest cells, each gets a k-th best score, and goes on only to cells whose bound reaches it. A
vector is sent only to groups of queries of which some go to its cell, and, once scores are known, only to those whose
own summary (pivot, radius, lowest k-th score) lets the vector itself reach that score. All scoring is local: a block of
a cell against a part of the queries. Cells and groups of any size are split, so a common vector fills many blocks and
none grows. What the driver holds is bounded by the pivots: a row a cell, and which cells send queries to which.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Pivots at least and at most (their number grows with the square root of the table), the rows that they are chosen
#: from, vectors a block, queries a part, and own cells that a query is scored in first.
PIVOTS, MOST, SAMPLE, BLOCK, PART, NEAREST = 64, 512, 4096, 2048, 8192, 2


def whole(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as array<long>; null where the vector or a component is null or not finite."""
    sound = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return F.when(embedding.isNotNull() & sound, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def matrix(column: pa.Array | pd.Series) -> np.ndarray:
    """Rows of a list column of one length."""
    if isinstance(column, pd.Series):
        return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def pivots_of(vectors: DataFrame, dim: int, n: int, sample: int) -> np.ndarray:
    """n distinct vectors spread by farthest-first choice over a sample bounded by `sample`, chosen by a hash of the id."""
    total = vectors.count()
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    rows = vectors.where(share <= min(1.0, 1.2 * sample / max(1, total))).orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
    pool = np.unique(np.array([r.v for r in rows], np.float64).reshape(-1, dim), axis=0) if rows else np.zeros((1, dim))
    chosen, near = [0], ((pool - pool[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(pool)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((pool - pool[chosen[-1]]) ** 2).sum(axis=1))
    return pool[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(axis=1)))


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k best candidates but itself: higher scores first, ties to smaller ids. Candidates come in ascending id order."""
    for i, row in enumerate(scores):
        keep = np.flatnonzero(ids != own[i])
        if len(keep) > k:
            s = row[keep]
            least = np.partition(s, len(s) - k)[len(s) - k]
            over, tied = keep[s > least], keep[s == least]
            keep = np.concatenate([over, tied[: k - len(over)]])
        yield i, keep, row[keep]


RESULT = "query_id long, vec_id long, score long"


def _solve(k: int):
    def solve(key: tuple, queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(queries) and len(data):
            data = data.sort_values("vec_id", kind="stable")
            ids, x, q, own = data.vec_id.to_numpy(), matrix(data.v), matrix(queries.v), queries.query_id.to_numpy()
            top = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1])
            exact = np.float64 if top < 2**52 else np.int64  # sums below 2^52 are exact, and fast, as doubles
            for at in range(0, len(q), 512):
                scores = q[at : at + 512].astype(exact) @ x.T.astype(exact)
                for i, keep, s in best(scores, ids, own[at : at + 512], k):
                    out.append(pd.DataFrame({"query_id": own[at + i], "vec_id": ids[keep], "score": s.astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    return solve


def top_k(vectors: DataFrame, query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", pivots: int | None = None, sample: int = SAMPLE, block: int = BLOCK, part: int = PART) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows by integer inner product for each row that `query` selects.

    Vectors that are null, empty, or hold null or non-finite components, and rows without an id, take no part; vectors of
    another length than the query's are no candidates of it. Rows that share an id are one candidate each, except for
    queries with that id. Other columns play no part. An empty table has an empty result.
    """
    spark = vectors.sparkSession
    ready = vectors.select(F.col(vec_id).cast("long").alias("id"), whole(F.col(embedding)).alias("v"), F.coalesce(query, F.lit(False)).alias("q"))
    ready = common.written(ready.where(F.col("v").isNotNull() & F.col("id").isNotNull() & (F.size("v") > 0)), "vectors")
    dims = [(r.d, r.n) for r in ready.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()]  # a few lengths
    out = None
    for dim, rows in sorted(dims):
        n = pivots or min(MOST, max(PIVOTS, math.isqrt(rows // 16)))
        own = Search(ready.where(F.size("v") == dim), dim, k, n, sample, block, part).result()
        out = own if out is None else out.unionByName(own)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out


def above(bound: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Where a bound reaches a score, whatever the rounding."""
    return bound + 1e-9 * np.abs(bound) + 1e-6 >= least


@dataclass
class Cells:
    """The summaries, a row a pivot, and the parts of each group of queries."""

    points: np.ndarray
    radius: np.ndarray
    inner: np.ndarray
    norm: np.ndarray
    q_radius: np.ndarray
    blocks: np.ndarray
    first: np.ndarray
    count: np.ndarray

    def __post_init__(self) -> None:
        self.gaps = distances(self.points, self.points)

    def bounds(self, q: np.ndarray, d: np.ndarray) -> np.ndarray:
        """For each query and cell a score that none in the cell exceeds.

        By the pivot and the radius; by the norms; and by the least distance that a vector may have from the query: what
        the cell's inner and outer radius leave, or the plane halfway between the cell's pivot and another.
        """
        square = (q * q).sum(axis=1)[:, None]
        near = np.maximum(0.0, np.maximum(d - self.radius, self.inner - d))
        own = d.argmin(axis=1)
        plane = (d * d - (d[np.arange(len(d)), own] ** 2)[:, None]) / np.maximum(2 * self.gaps[own], 1e-300)
        near = np.maximum(near, np.where(self.gaps[own] > 0, plane, 0.0) * (1 - 1e-9) - 1e-6)
        by_distance = (square + self.norm**2 - np.maximum(0.0, near) ** 2) / 2
        return np.minimum(np.minimum(q @ self.points.T + np.sqrt(square) * np.maximum(self.radius, 0), np.sqrt(square) * self.norm), by_distance)


class Search:
    """The search among vectors of one length."""

    def __init__(self, ready: DataFrame, dim: int, k: int, n: int, sample: int, block: int, part: int):
        self.k, points = k, pivots_of(ready, dim, n, sample)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in common.slices(batches):
                x = matrix(b.column(1)).astype(np.float64)
                d = distances(x, points)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(cell)), cell], pa.float64()), pa.array(np.sqrt((x * x).sum(axis=1)))], ["id", "v", "q", "cell", "far", "norm"])

        self.placed = common.written(ready.mapInArrow(assign, "id long, v array<long>, q boolean, cell int, far double, norm double"), "cells")
        own = F.when(F.col("q"), F.col("far"))
        cells = self.placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.min("far").alias("inner"), F.max("norm").alias("norm"), F.count(own).alias("queries"), F.max(own).alias("q_radius")).collect()  # a row a pivot
        m = len(points)
        radius, inner, norm, q_radius = np.full(m, -1.0), np.zeros(m), np.zeros(m), np.zeros(m)
        blocks, queries = np.ones(m, np.int64), np.zeros(m, np.int64)
        for c in cells:
            radius[c.cell], inner[c.cell], norm[c.cell], q_radius[c.cell] = c.radius, c.inner, c.norm, c.q_radius or 0.0
            blocks[c.cell], queries[c.cell] = max(1, math.ceil(c.n / block)), c.queries
        self.cells = Cells(points, radius, inner, norm, q_radius, blocks, *parts_of(queries, points, part))

    def of_cell(self, values: np.ndarray) -> Column:
        """A column of the value of each row's cell."""
        return F.element_at(F.array(*[F.lit(int(x)) for x in values]), F.col("cell") + 1)

    def queries(self) -> DataFrame:
        """query_id, v, part, own: a query's part comes from a hash, so that equal ids spread as well."""
        part = self.of_cell(self.cells.first) + F.pmod(F.xxhash64("id"), self.of_cell(self.cells.count))
        return self.placed.where("q").select(F.col("id").alias("query_id"), "v", part.cast("int").alias("part"), F.col("cell").alias("own"))

    def routed(self, queries: DataFrame, final: bool) -> DataFrame:
        """query_id, v, part, own, cell: to the nearest cells, or, with a k-th score known, to the others that may hold better."""
        cells = self.cells

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in common.slices(batches):
                q = matrix(b.column(1)).astype(np.float64)
                d = distances(q, cells.points)
                some = np.where(cells.radius < 0, np.inf, d)
                chosen = np.zeros(d.shape, bool)
                np.put_along_axis(chosen, np.argsort(some, axis=1, kind="stable")[:, :NEAREST], True, axis=1)
                if final:
                    chosen = ~chosen & above(cells.bounds(q, d), b.column(4).to_numpy(zero_copy_only=False)[:, None])
                chosen &= cells.radius >= 0
                rows, cell = np.nonzero(chosen)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([*[b.column(i).take(take) for i in range(4)], pa.array(cell.astype(np.int32))], ["query_id", "v", "part", "own", "cell"])

        return common.written(queries.mapInArrow(route, "query_id long, v array<long>, part int, own int, cell int"), "routed")

    def sent(self, reach: np.ndarray, least: np.ndarray | None) -> DataFrame:
        """cell, block, part, vec_id, v: each vector for the parts that need it.

        reach: whether queries of a group (column) go to a cell (row); least: the lowest k-th score in each group.
        """
        cells = self.cells

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in common.slices(batches):
                x, want = matrix(b.column(3)).astype(np.float64), reach[b.column(0).to_numpy()]
                if least is not None:
                    want = want & above(x @ cells.points.T + np.sqrt((x * x).sum(axis=1))[:, None] * cells.q_radius, least)
                row, group = np.nonzero(want)
                times = cells.count[group]
                begin = np.repeat(np.cumsum(times) - times, times)
                both = np.unique(np.stack([np.repeat(row, times), np.repeat(cells.first[group], times) + np.arange(len(begin)) - begin]), axis=1)
                take = pa.array(both[0])
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(both[1].astype(np.int32)), b.column(2).take(take), b.column(3).take(take)], ["cell", "block", "part", "vec_id", "v"])

        block = F.pmod(F.xxhash64("id", "v"), self.of_cell(self.cells.blocks)).cast("int")
        return self.placed.select("cell", block.alias("block"), F.col("id").alias("vec_id"), "v").mapInArrow(send, "cell int, block int, part int, vec_id long, v array<long>")

    def solved(self, routed: DataFrame, least: np.ndarray | None) -> DataFrame:
        """query_id, vec_id, score: the k best of each block for each query that goes there."""
        reach = np.zeros((len(self.cells.points),) * 2, bool)
        for r in routed.select("cell", "own").distinct().collect():  # pivots squared at most
            reach[r.cell, r.own] = True
        each = routed.select("query_id", "v", "part", "cell", F.explode(F.sequence(F.lit(0), (self.of_cell(self.cells.blocks) - 1).cast("int"))).alias("block"))
        keys = ["cell", "block", "part"]
        return each.groupBy(*keys).cogroup(self.sent(reach, least).groupBy(*keys)).applyInPandas(_solve(self.k), RESULT)

    def rest(self, first: DataFrame) -> tuple[DataFrame, np.ndarray]:
        """The queries routed on, with the k-th scores of a first round, and each group's lowest of these."""
        kth = first.withColumn("rank", ranks()).where(F.col("rank") == self.k).select(F.col("query_id").alias("k_id"), F.col("score").cast("double").alias("kth"))
        known = self.queries().join(kth, F.col("query_id") == F.col("k_id"), "left").select("query_id", "v", "part", "own", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"))
        known = common.written(known, "known")
        least = np.full(len(self.cells.points), np.inf)
        for r in known.groupBy("own").agg(F.min("kth").alias("least")).collect():  # a row a pivot
            least[r.own] = r.least
        return self.routed(known, True), least

    def result(self) -> DataFrame:
        first = common.written(self.solved(self.routed(self.queries(), False), None), "near")
        routed, least = self.rest(first)
        ranked = first.unionByName(self.solved(routed, least)).withColumn("rank", ranks()).where(F.col("rank") <= self.k)
        return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def ranks() -> Column:
    return F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc()))


def parts_of(queries: np.ndarray, points: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first part and the number of parts of each group of queries: large groups are split, small ones share a part."""
    first, count, part, held = np.zeros(len(queries), np.int64), np.ones(len(queries), np.int64), 0, 0
    for g in np.argsort(points @ (points[-1] - points[0]), kind="stable"):
        n = int(queries[g])
        if held and held + n > size:
            part, held = part + 1, 0
        first[g], count[g] = part, max(1, math.ceil(n / size))
        held += n
        if count[g] > 1:
            part, held = part + int(count[g]), 0
    return first, count


#: Brute force in SQL over a table `embeddings`.
SQL = """
WITH ready AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM ready q JOIN ready c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 5
"""
