"""Exact retrieval by blocks against the plain expression, score by score."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexloom.functions import vectors
from lexloom.operators import retrieval


def plain(queries, points):
    return points.crossJoin(queries).select("query_id", "id", F.round(vectors.cosine(F.col("q"), F.col("v")), 9).alias("score"))


def test_blocks_give_the_plain_scores(spark, monkeypatch):
    """Copies, ties, nulls, short vectors, zeros and not-a-number, in many small blocks; no score leaves its task but the best."""
    monkeypatch.setattr(retrieval, "POINTS", 50)
    monkeypatch.setattr(retrieval, "QUERIES", 4)
    monkeypatch.setattr(retrieval, "TOGETHER", 120)
    rng = random.Random(5)
    made = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(40)]
    rows = [(f"p{n:03d}", made[n % 40] if n % 3 else [2 * x for x in made[n % 40]]) for n in range(200)]
    rows += [("q1", None), ("q2", [1.0, None, 0.0, 0.0, 0.0, 0.0]), ("q3", [1.0, 2.0]), ("q4", [0.0] * 6), ("q5", [float("nan")] * 6), ("q6", [0.6, 0.8, 0.0, 0.0, 0.0, 0.0])]
    points = spark.createDataFrame(rows, "id string, v array<double>")
    queries = spark.createDataFrame([(n, made[n]) for n in range(9)] + [(10, None), (11, [1.0, 2.0]), (12, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (13, [0.0] * 6)], "query_id int, q array<double>")
    shown = lambda df: sorted((r.query_id, r.id, repr(r.score), r["rank"]) for r in df.collect())
    near = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    want = plain(queries, points).withColumn("rank", F.row_number().over(near)).where("rank <= 7")
    assert shown(retrieval.top_k(queries, points, 7)) == shown(want)
    assert shown(retrieval.top_k(queries, points, 7, 0.6)) == shown(want.where("score >= 0.6"))
    counted = plain(queries, points).where("score >= 0.6").groupBy("query_id").agg(F.count("*").alias("near"))
    assert sorted(map(tuple, retrieval.above(queries, points, 0.6).collect())) == sorted(map(tuple, counted.collect()))
    plan = retrieval.top_k(queries, points, 7)._jdf.queryExecution().toString()
    assert "Generate explode(qs" not in plan and "FlatMapCoGroupsInArrow" in plan
    none = points.where("false")
    assert retrieval.top_k(queries, none, 3).count() == 0 and retrieval.top_k(queries.where("false"), points, 3).count() == 0
