"""Exact vector retrieval and its measures.

Each of a stated set of queries is compared with all points, which is quadratic where the queries are a share of the points. Queries and points are dealt
to blocks by a hash of the id; a task multiplies one block of queries with one of points, TOGETHER scores at once, and hands on k rows or one count for each
query. So scores stay in their task, and neither side is held whole anywhere.

The product only chooses: scores near the last place or the threshold are taken again, in the order of the components, as vectors.cosine
takes them. Defined cases: a null vector or component, or lengths that differ, give a null score, which is the last; not-a-number is the first.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Points and queries of a block, about.
POINTS, QUERIES = 8192, 2000
#: Scores that a task holds at once.
TOGETHER = 1 << 22
#: What nine digits and the order of a sum may change.
MARGIN = 2e-9


class _Rows:
    """Vectors as rows, zeros behind the shorter; their lengths, -1 where one is null or holds a null; their norms."""

    def __init__(self, column: pa.ChunkedArray):
        lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, held = lists.flatten(), lists.is_valid().to_numpy(zero_copy_only=False)
        self.v = np.zeros((len(sizes), int(sizes.max()) if len(sizes) else 0))
        self.v[np.arange(self.v.shape[1])[None] < sizes[:, None]] = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
        broken = np.unique(np.repeat(np.arange(len(sizes)), sizes)[flat.is_null().to_numpy(zero_copy_only=False)])
        self.sizes = np.where(held, sizes, -1)
        self.sizes[broken] = -1
        self.norms = np.sqrt(_in_order(self.v, self.v))

    def wide(self, width: int) -> np.ndarray:
        return np.pad(self.v, ((0, 0), (0, width - self.v.shape[1])))


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row the dot product, added from the first component to the last."""
    out = np.zeros(max(len(a), len(b)))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def _nine(scores: np.ndarray) -> np.ndarray:
    """Rounded to nine digits as Spark does."""
    values, at = np.unique(scores, return_inverse=True)
    return np.array([float(Decimal(repr(x)).quantize(Decimal("1e-9"), ROUND_HALF_UP)) if np.isfinite(x) else x for x in values.tolist()], np.float64)[at]


class _Tile:
    """A block of queries and one of points; `about` gives some queries' scores, `exact` those of one with some points."""

    def __init__(self, asked: pa.Table, points: pa.Table):
        self.a, self.b = _Rows(asked.column("q")), _Rows(points.column("v"))
        width = max(self.a.v.shape[1], self.b.v.shape[1])
        self.q, self.v = self.a.wide(width), self.b.wide(width)
        self.step = max(1, TOGETHER // max(1, len(self.v)))

    def about(self, at: int) -> np.ndarray:
        """Of the queries from `at` on; -inf in place of null, inf in place of not-a-number."""
        own = slice(at, at + self.step)
        with np.errstate(all="ignore"):
            scores = self.q[own] @ self.v.T
            scores /= self.a.norms[own, None] * self.b.norms[None] + 1e-10
        scores[np.isnan(scores)] = np.inf
        scores[(self.a.sizes[own, None] != self.b.sizes[None]) | (self.a.sizes[own, None] < 0)] = -np.inf
        return scores

    def exact(self, n: int, some: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return _nine(_in_order(self.q[n : n + 1], self.v[some]) / (self.a.norms[n] * self.b.norms[some] + 1e-10))


def _best(k: int):
    def best(asked: pa.Table, points: pa.Table) -> pa.Table:
        tile, order = _Tile(asked, points), pc.rank(points.column("id"), null_placement="at_start", tiebreaker="first").to_numpy().astype(np.int64)
        rows, cols, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for at in range(0, len(tile.q) if len(order) else 0, tile.step):
            for n, row in enumerate(tile.about(at), at):
                some = np.arange(len(row)) if len(row) <= k else np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k] - MARGIN)
                null = row[some] == -np.inf
                own = tile.exact(n, some)
                key = np.where(null, -np.inf, np.where(np.isnan(own), np.inf, own))
                first = np.lexsort((order[some], -key))[:k]
                rows.append(np.full(len(first), n))
                cols.append(some[first])
                scores.append(np.where(null, -np.inf, own)[first])
        score = np.concatenate(scores)
        return pa.table({"query_id": asked.column("query_id").take(pa.array(np.concatenate(rows))), "id": points.column("id").take(pa.array(np.concatenate(cols))), "score": pa.array(score, mask=score == -np.inf)})

    return best


def _reached(threshold: float):
    def reached(asked: pa.Table, points: pa.Table) -> pa.Table:
        tile = _Tile(asked, points)
        near = np.zeros(len(tile.q), np.int64)
        for at in range(0, len(near) if len(tile.v) else 0, tile.step):
            scores = tile.about(at)
            near[at : at + tile.step] = (scores >= threshold + MARGIN).sum(1)
            close = np.abs(scores - threshold) < MARGIN
            for n in np.flatnonzero(close.any(1)).tolist():
                near[at + n] += int((tile.exact(at + n, np.flatnonzero(close[n])) >= threshold).sum())
        some = np.flatnonzero(near)
        return pa.table({"query_id": asked.column("query_id").take(pa.array(some)), "near": near[some]})

    return reached


def _tiles(queries: DataFrame, points: DataFrame, work, *found: T.StructField) -> DataFrame:
    """What work gives of each block of queries(query_id, q) beside each block of points(id, v)."""
    down, across = (max(1, -(-rows.count() // size)) for rows, size in ((queries, QUERIES), (points, POINTS)))
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = queries.select(dealt("query_id", down).alias("i"), number(across).alias("j"), F.col("query_id").alias("query_id"), F.col("q").alias("q"))
    right = points.select(number(down).alias("i"), dealt("id", across).alias("j"), F.col("id").alias("id"), F.col("v").alias("v"))
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), *found])
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(work, schema)


def above(queries: DataFrame, points: DataFrame, threshold: float) -> DataFrame:
    """(query_id, near): how many points reach a score, counted in each task before the exchange."""
    return _tiles(queries, points, _reached(threshold), T.StructField("near", T.LongType())).groupBy("query_id").agg(F.sum("near").alias("near"))


def top_k(queries: DataFrame, points: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k points of the highest cosine for each query; ties by id."""
    scored = _tiles(queries, points, _best(k), T.StructField("id", points.schema["id"].dataType), T.StructField("score", T.DoubleType()))
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    near = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)


def measures(found: Column, expected: Column) -> Column:
    """(recall, precision): hits over expected, and hits over the length of the list found."""
    hits = F.size(F.array_intersect(found, expected))
    return F.struct(
        F.when(F.size(F.array_distinct(expected)) > 0, hits / F.size(F.array_distinct(expected))).otherwise(0.0).alias("recall"),
        F.when(F.size(found) > 0, hits / F.size(found)).otherwise(0.0).alias("precision"),
    )
