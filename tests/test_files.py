"""Sources, sinks and streams on files made here."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lexloom.operators import graph
from lexloom.sources import readers, seed, sinks, tables
from lexloom.streaming import feeds


def test_index_archives(spark, tmp_path):
    law = lambda code, name, gone="": {"LawName": name, "LawLevel": "L", "LawCategory": "c", "LawURL": f"https://x/LawAll.aspx?pcode={code}", "LawModifiedDate": "20200101", "LawEffectiveDate": "", "LawAbandonNote": gone}
    for k, content in enumerate(({"Laws": [law("A0000001", "one"), law("A0000002", "two", "gone")]}, [law("B0000003", "three"), {"LawName": "no code", "LawURL": ""}])):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            z.writestr("readme.txt", "x")
            z.writestr("laws.json", "﻿" + json.dumps(content))
        (tmp_path / f"{k}.zip").write_bytes(buffer.getvalue())
    got = {(r.pcode, r.name, r.abolished) for r in readers.index_archives(spark, str(tmp_path)).collect()}
    assert got == {("A0000001", "one", False), ("A0000002", "two", True), ("B0000003", "three", False)}


def test_snapshots_graphs_and_query_sets(spark, tmp_path):
    (tmp_path / "snap").mkdir()
    (tmp_path / "snap" / "A1.json").write_text(json.dumps({"20200101": {"1": "x", "9-1": "y"}, "_oldver": {"1": "z"}}))
    assert {tuple(r) for r in readers.snapshots(spark, f"{tmp_path}/snap").collect()} == {("A1", "20200101", "1", "x"), ("A1", "20200101", "9-1", "y")}
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "a", "label": "A", "type": "Article"}], "edges": [{"source": "a", "target": "a", "type": "is_a"}]}))
    nodes, edges = readers.graph(spark, f"{tmp_path}/g.json")
    assert nodes.first().metadata == {} and edges.first()[:3] == ("a", "a", "is_a")
    (tmp_path / "q.json").write_text(json.dumps({"queries": [{"id": "q1", "query": "?", "expected_articles": ["1"], "domain": "d"}]}))
    assert readers.query_set(spark, f"{tmp_path}/q.json").first().expected_articles == ["1"]
    (tmp_path / "doc.md").write_text("a\nb")
    assert readers.documents(spark, f"{tmp_path}/doc.md").first().raw == "a\nb"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'say "x", y'), (2, None)], "id int, text string")
    for _ in range(2):
        sinks.csv(rows, f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True, escape='"').where("id = 1").distinct().collect()[0].text == 'say "x", y'
    sinks.json(rows, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 2


def test_daily_sync_runs_once_over_what_has_arrived(spark, tmp_path):
    index = "pcode string, current string, abolished boolean"
    spark.createDataFrame([("A", "20200101", False), ("A", "20210101", False), ("B", "20200101", True)], index).write.parquet(f"{tmp_path}/in")
    tracked = spark.createDataFrame([("A", "20200101"), ("B", "20200101"), ("C", "20200101")], "pcode string, baseline string")
    for _ in range(2):
        feeds.sync(spark.readStream.schema(index).parquet(f"{tmp_path}/in"), tracked, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = {r.pcode: r.status for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {"A": "changed", "B": "abolished", "C": "missing"} and spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_quota_counts_are_the_same_over_a_stream(spark, tmp_path):
    events = spark.sql("SELECT id AS event_id, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id * 7) AS ts, id % 3 AS user_id, 'x' AS event_type FROM range(40)")
    events.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    query = feeds.daily_counts(stream).writeStream.outputMode("complete").format("memory").queryName("quota").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("quota").collect()} == {tuple(r) for r in feeds.daily_counts(events).collect()}
    assert feeds.once(events.union(events)).count() == 40 and feeds.sliding_counts(events).agg(F.sum("calls")).first()[0] == 80


def test_tracker_tables_are_made_once_and_filled(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS tracker")
    rows = spark.createDataFrame([(1, "one")], "pcode int, name string")
    for _ in range(2):
        tables.create(spark, "tracker")
    tables.append(rows, "tracked_regulations", "tracker")
    tables.append(spark.createDataFrame([("1", "changed")], "pcode string, status string"), "check_history", "tracker")
    assert [tuple(r) for r in spark.table("tracker.tracked_regulations").collect()] == [("1", "one", "", None, None, 7, None, None)]
    assert spark.table("tracker.check_history").first().status == "changed" and spark.table("tracker.law_cache").count() == 0
    spark.sql("DROP DATABASE tracker CASCADE")


def test_seed_graph_takes_texts_from_articles(spark):
    nodes, edges = seed.graph(spark)
    assert graph.dangling(nodes, edges).count() == 0 and nodes.count() == nodes.select("id").distinct().count()
    texts = {r.id: r.metadata for r in seed.with_texts(nodes, spark.createDataFrame([("184", "x")], "article_no string, text string")).collect()}
    assert texts["art-184"] == {"text": "x"} and texts["art-185"] == {} and len(texts) == nodes.count()


def _events(spark, *of):
    return spark.createDataFrame(list(of), "event_id long, t string, user_id long, event_type string").select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "event_type")


def test_sessions_and_late_rows(spark, tmp_path):
    drops = [
        _events(spark, (1, "2024-01-01 10:00:00", 1, "view"), (2, "2024-01-01 10:20:00", 1, "purchase"), (3, "2024-01-01 12:00:00", 1, "view"), (4, "2024-01-01 10:00:00", 2, "view")),
        _events(spark, (5, "2024-01-01 09:00:00", 1, "view"), (6, "2024-01-01 12:10:00", 1, "purchase")),
        _events(spark, (7, "2024-01-03 00:00:00", 9, "view")),
    ]
    late = []
    for drop in drops:
        drop.write.mode("append").parquet(f"{tmp_path}/in")
        run = feeds.append(feeds.sessions(spark.readStream.schema(drop.schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/state")
        run.awaitTermination()
        late.append(feeds.dropped(run))
    got = sorted((r.user_id, str(r.start), str(r.end), r.calls) for r in spark.read.parquet(f"{tmp_path}/out/batch=*").collect())
    assert got == [(1, "2024-01-01 10:00:00", "2024-01-01 10:50:00", 2), (1, "2024-01-01 12:00:00", "2024-01-01 12:40:00", 2), (2, "2024-01-01 10:00:00", "2024-01-01 10:30:00", 1)]
    assert late == [0, 1, 0]
    batch = feeds.sessions(drops[0].unionByName(drops[1].where("event_id = 6")))
    assert sorted((r.user_id, str(r.start), str(r.end), r.calls) for r in batch.collect()) == got


def test_sketches_merge_to_their_rows(spark):
    from lexloom.operators import sketches

    rows = spark.range(60_000).selectExpr("id % 30 AS day", "id % 2 AS k", "id * 7919 % 20011 AS who", "CAST(id AS DOUBLE) AS v").unionByName(spark.sql("SELECT 1L AS day, 1L AS k, CAST(NULL AS LONG) AS who, CAST(NULL AS DOUBLE) AS v"))
    days = sketches.daily(rows, "day", ["k"], "who", "v")
    for period in (F.lit(0), F.floor(F.col("day") / 10)):
        for r in sketches.merged(days, ["k"], period).select("k", "period", "n", sketches.members("members").alias("m"), sketches.quantile("spread", 0.9).alias("q")).collect():
            own = rows.where(F.col("k") == r.k).where(period == r.period)
            exact, below = own.agg(F.count_distinct("who"), F.avg((F.col("v") <= r.q).cast("int"))).first()
            assert abs(r.m - exact) <= sketches.ERROR * exact + 1 and abs(below - 0.9) <= sketches.RANK and r.n == own.count()
    assert sketches.daily(rows.limit(0), "day", ["k"], "who", "v").count() == 0


def test_snapshots_of_many_laws_in_a_file(spark, tmp_path):
    lines = [{"pcode": "A1", "versions": {"20200101": {"1": "x"}, "_old": {"1": "z"}}}, {"pcode": "B2", "versions": {"20210101": {"1": "y", "2": "w"}}}, {"pcode": "C3", "versions": {}}]
    (tmp_path / "laws.json").write_text("\n".join(map(json.dumps, lines)))
    assert {tuple(r) for r in readers.snapshot_lines(spark, str(tmp_path)).collect()} == {("A1", "20200101", "1", "x"), ("B2", "20210101", "1", "y"), ("B2", "20210101", "2", "w")}


def test_a_stated_set_is_counted_before_it_is_sent(spark, monkeypatch):
    from lexloom.plans import derived

    monkeypatch.setattr(derived, "FEW", 3)
    assert len(derived._few(spark.range(3), "id").first().d) == 3
    with pytest.raises(ValueError):
        derived._few(spark.range(4), "id")
