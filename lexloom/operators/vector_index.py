"""An inverted-file vector index: cells of a k-means as parts of a stored table, and a choice of cells for each query.

Centroids are fitted by Spark's own k-means on the directions of a bounded sample (SAMPLE rows, by a threshold on the ids' hashes); all points are indexed, each in
the cell of its nearest centroid. There are about as many cells as the square root of the points, at most CELLS, so the centroids
(CELLS x the dimension) are a side that can be broadcast by proof.

A search reads the folders of the probed cells only. `probes` cells are read for each query; with exact=True
a second pass reads each cell that may still hold a better point: by the triangle inequality of
angles no point of a cell is nearer than the angle to its centroid less the cell's widest angle. Probing all cells is exact, too.
Queries meet the points of a cell where these are read: the queries' side is broadcast within counted bounds (SIDE_ROWS probes, SIDE_VALUES numbers), and each batch
of points is multiplied by the queries that probe its cell, of which it hands on `k` rows each. Beyond the bounds both sides are joined on the cell, so
that Spark can split a hot one.

Points may be added, replaced and deleted: the cells that hold the ids before and after are written anew, in one commit. A cell's
widest angle only grows, which keeps the bound right.

Defined cases: scores are cosines rounded to nine digits as elsewhere, ties go by the id; a zero vector has cosine 0 to all and lies
in the first cell, whose widest angle is then taken as a half turn; null ids or vectors are left out; equal ids in one upsert: the least vector stands; a search of an empty index gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import vectors
from lexloom.sources.shared import checkpoint
from lexloom.sources.stored import Stored

SAMPLE, CELLS, ROUNDS = 65_536, 4096, 8
#: Probes, and numbers of the queries' vectors, of a side that is broadcast.
SIDE_ROWS, SIDE_VALUES = 4_000_000, 4_000_000
#: Scores that a task holds at once.
TOGETHER = 1 << 22
#: What rounding may add to an angle.
SLACK = 1e-6


def _norm(v: Column) -> Column:
    return F.sqrt(vectors.dot(v, v))


def _points(rows: DataFrame) -> DataFrame:
    """id and v, one row for each id."""
    some = rows.where("id IS NOT NULL AND v IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    return some.groupBy("id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a width, zeros behind the shorter and for nulls; what is beyond the width goes."""
    lengths = column.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    out = np.zeros((len(lengths), max(width, int(lengths.max()) if len(lengths) else 0)))
    out[np.arange(out.shape[1])[None] < lengths[:, None]] = column.flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
    return out[:, :width]


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of a with each of b, as vectors.cosine takes it."""
    return a @ b.T / (np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None] + 1e-10)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_cosines(a, b), -1, 1))


def _pieces(batches: Iterator[pa.RecordBatch], wide: int) -> Iterator[pa.RecordBatch]:
    """Batches of so few rows that rows x wide stays within TOGETHER."""
    rows = max(1, TOGETHER // max(1, wide))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties by the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType()))])
        self.points = Stored(spark, f"{self.path}/points", schema, ["id"])
        cells = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("c", T.ArrayType(T.DoubleType())), T.StructField("widest", T.DoubleType())])
        self.cells = Stored(spark, f"{self.path}/cells", cells, ["cell"], parts=1)

    def build(self, rows: DataFrame, cells: int | None = None, sample: int = SAMPLE, rounds: int = ROUNDS) -> VectorIndex:
        """Fit the centroids and index all rows(id, v)."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        points = checkpoint(_points(rows))
        n = points.count()
        wanted = max(1, min(CELLS, cells or round(math.sqrt(n))))
        chosen = points.where(_norm(F.col("v")) > 0)
        if n > sample:
            chosen = chosen.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
        chosen = checkpoint(chosen.select(array_to_vector("v").alias("features")))
        centers = [(0, [0.0], 0.0)]
        if not chosen.isEmpty():
            model = KMeans(k=wanted, distanceMeasure="cosine", seed=1, maxIter=rounds).fit(chosen)
            centers = [(k, [float(x) for x in c], 0.0) for k, c in enumerate(model.clusterCenters())]
        self.cells.replace(self.spark.createDataFrame(centers, self.cells.schema))
        self.upsert(points)
        return self

    def _centroids(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells, centroids and widest angles: CELLS rows at most."""
        rows = sorted(self.cells.rows().collect())
        width = max((len(r.c) for r in rows), default=0)
        return np.array([r.cell for r in rows], np.int32), np.array([[*r.c, *[0.0] * (width - len(r.c))] for r in rows]).reshape(len(rows), width), np.array([r.widest for r in rows])

    def _placed(self, points: DataFrame) -> DataFrame:
        """points with their cell (part) and the angle to its centroid."""
        cells, centers, _ = self._centroids()

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _pieces(batches, len(cells)):
                v = _matrix(batch.column("v"), centers.shape[1])
                angles = _angles(v, centers)
                at = angles.argmin(1)
                zero = ~v.any(1)
                at[zero] = 0
                angle = np.where(zero, math.pi, angles[np.arange(len(at)), at])
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cells[at]), pa.array(angle)], ["id", "v", "part", "angle"])

        return points.select("id", "v").mapInArrow(placed, "id long, v array<double>, part int, angle double")

    def upsert(self, rows: DataFrame) -> int:
        """Add points or replace those of the same id; how many came."""
        new = checkpoint(self._placed(_points(rows)))
        widest = new.groupBy(F.col("part").alias("cell")).agg(F.max("angle").alias("angle"))
        told = self.cells.rows().join(widest, "cell").select("cell", "c", F.greatest("widest", "angle").alias("widest"))
        self.cells.replace(checkpoint(told))  # before the points: a wider cell is right for the old ones, too
        self._change(new.drop("angle"), new.select("id"))
        return new.count()

    def delete(self, ids: DataFrame) -> int:
        """Take out the points of these ids; how many there were."""
        return self._change(None, ids.select(F.col("id").cast("long").alias("id")).distinct())

    def _change(self, new: DataFrame | None, ids: DataFrame) -> int:
        version = self.points.version()
        held = {r[0]: r[1] for r in self.points.read(version=version).select("id", "part").join(ids, "id", "left_semi").groupBy("part").agg(F.count("*")).collect()}  # a row a cell
        touched = set(held) | ({r[0] for r in new.select("part").distinct().collect()} if new is not None else set())
        if touched:
            rest = self.points.read(list(touched), version).join(ids, "id", "left_anti").select("id", "v", "part")
            self.points.rewrite(list(touched), rest.unionByName(new) if new is not None else rest, version)
        return sum(held.values())

    def search(self, queries: DataFrame, k: int, probes: int | None = None, threshold: float | None = None, exact: bool = False) -> DataFrame:
        """(query_id, id, score, rank): the k points of the highest cosine in the probed cells (all, if not said) for each of queries(query_id long, q)."""
        cells, centers, widest = self._centroids()

        def aimed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _pieces(batches, len(cells)):
                angles = _angles(_matrix(batch.column("q"), centers.shape[1]), centers)
                order = np.argsort(angles, 1, kind="stable")
                near = pa.StructArray.from_arrays([pa.array(cells[order].ravel()), pa.array((np.take_along_axis(angles, order, 1) - widest[order]).ravel())], ["cell", "least"])
                near = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(cells)), near)
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("q"), near], ["query_id", "q", "near"])

        asked = queries.where("query_id IS NOT NULL AND q IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.col("q").cast("array<double>").alias("q"))
        asked = checkpoint(asked.mapInArrow(aimed, "query_id long, q array<double>, near array<struct<cell:int,least:double>>"))
        first = F.col("near") if probes is None else F.slice("near", 1, probes)
        best = self._best(asked.select("query_id", "q", F.transform(first, lambda x: x["cell"]).alias("cells")), k, threshold)
        if exact and probes is not None and probes < len(cells):
            best = checkpoint(best)
            last = best.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
            reach = F.when(F.col("n") >= k, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("least") - 1e-8))))
            wide = 2 * math.pi if threshold is None else math.acos(min(1.0, max(-1.0, threshold - 1e-8)))
            more = asked.join(last, "query_id", "left").withColumn("reach", F.least(F.coalesce(reach, F.lit(wide)), F.lit(wide)))
            rest = F.filter(F.slice("near", probes + 1, len(cells)), lambda x: x["least"] <= F.col("reach") + SLACK)
            more = more.select("query_id", "q", F.transform(rest, lambda x: x["cell"]).alias("cells")).where(F.size("cells") > 0)
            best = _ranked(best.drop("rank").unionByName(self._best(more, k, threshold).drop("rank")), k)
        return best

    def _best(self, asked: DataFrame, k: int, threshold: float | None) -> DataFrame:
        """The k best of the probed cells, for asked(query_id, q, cells)."""
        asked = checkpoint(asked)
        size = asked.agg(F.coalesce(F.sum(F.size("cells")), F.lit(0)).alias("probes"), F.coalesce(F.sum(F.size("q")), F.lit(0)).alias("numbers")).first()
        wanted = [r[0] for r in asked.select(F.explode("cells")).distinct().collect()]  # CELLS at most
        points = self.points.read(wanted)
        if size.probes > SIDE_ROWS or size.numbers > SIDE_VALUES:
            met = points.join(asked.select("query_id", "q", F.explode("cells").alias("part")), "part")
            met = met.select("query_id", "id", F.round(vectors.cosine(F.col("q"), F.col("v")), 9).alias("score"))
        else:
            met = points.mapInArrow(self._met(asked.collect(), k), "query_id long, id long, score double")
        return _ranked(met if threshold is None else met.where(F.col("score") >= threshold), k)

    def _met(self, asked: list, k: int):
        """Of each batch of points the k best for each query that probes their cell; asked is within the bounds of a broadcast."""
        width = max((len(r.q) for r in asked), default=0)
        of: dict[int, list[int]] = {}
        for n, r in enumerate(asked):
            for cell in r.cells:
                of.setdefault(cell, []).append(n)
        names, matrix = np.array([r.query_id for r in asked], np.int64), np.array([[*r.q, *[0.0] * (width - len(r.q))] for r in asked]).reshape(len(asked), width)
        sent = self.spark.sparkContext.broadcast((names, matrix, {c: np.array(n) for c, n in of.items()}))

        def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, matrix, of = sent.value
            for batch in _pieces(batches, len(names)):
                part, ids, v = batch.column("part").to_numpy(), batch.column("id").to_numpy(), _matrix(batch.column("v"), width)
                out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
                for cell in np.unique(part).tolist():
                    mine, own = np.flatnonzero(part == cell), of.get(cell, np.zeros(0, np.int64))
                    scores = np.round(_cosines(matrix[own], v[mine]), 9)
                    for n, row in zip(own.tolist(), scores, strict=True):
                        best = _best_of(row, ids[mine], k)
                        for x, values in zip(out, (np.full(len(best), names[n]), ids[mine][best], row[best]), strict=True):
                            x.append(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["query_id", "id", "score"])

        return met


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    near = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)


def recall(found: DataFrame, wanted: DataFrame) -> float:
    """The share of wanted (query_id, id) that was found."""
    both = wanted.select("query_id", "id").join(found.select("query_id", "id"), ["query_id", "id"], "left_semi")
    return both.count() / max(1, wanted.count())
