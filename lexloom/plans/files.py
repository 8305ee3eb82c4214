"""Sinks and sources over whole tables: what is written to the shared folder is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexloom.sources import readers, shared, sinks

from .registry import query


def _path(spark, name: str) -> str:
    return f"{shared.folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT o_orderkey, 'say \"' || o_orderpriority || '\", ' || o_orderstatus || chr(39) AS text, o_totalprice FROM orders")
def s19_csv_round_trip(spark, read):
    """Results as CSV with a header, quotes and commas kept, and read back."""
    rows = read("orders").select("o_orderkey", F.concat(F.lit('say "'), "o_orderpriority", F.lit('", '), "o_orderstatus", F.lit("'")).alias("text"), "o_totalprice")
    sinks.csv(rows, path := _path(spark, "csv"))
    return spark.read.csv(path, header=True, escape='"', schema="o_orderkey long, text string, o_totalprice double")


@query("SELECT user_id, count(*) AS calls, count(DISTINCT event_type) AS kinds, max(event_type) AS last FROM events GROUP BY 1")
def s20_report_round_trip(spark, read):
    """A report as JSON lines, and read back."""
    rows = read("events").groupBy("user_id").agg(F.count("*").alias("calls"), F.count_distinct("event_type").alias("kinds"), F.max("event_type").alias("last"))
    sinks.json(rows, path := _path(spark, "json"))
    return spark.read.schema("user_id long, calls long, kinds long, last string").json(path)


@query("SELECT 'n' || n_nationkey AS id, n_name AS label, CASE WHEN n_nationkey % 2 = 0 THEN 'x' || n_regionkey ELSE '' END AS text, 'r' || n_regionkey AS above FROM nation")
def s13_graph_round_trip(spark, read):
    """A graph's nodes and edges as JSON files, one for each region, and read back; missing metadata is empty."""
    nation = read("nation")
    node = F.struct(F.expr("'n' || n_nationkey").alias("id"), F.col("n_name").alias("label"), F.lit("Chapter").alias("type"), F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("text"), F.expr("'x' || n_regionkey"))).alias("metadata"))
    edge = F.struct(F.expr("'r' || n_regionkey").alias("source"), F.expr("'n' || n_nationkey").alias("target"), F.lit("has_part").alias("type"))
    files = nation.groupBy("n_regionkey").agg(F.to_json(F.struct(F.collect_list(node).alias("nodes"), F.collect_list(edge).alias("edges"))).alias("value"))
    files.write.partitionBy("n_regionkey").text(path := _path(spark, "graph"))
    nodes, edges = readers.graph(spark, f"{path}/*")
    return nodes.join(edges.select(F.col("dst").alias("id"), F.col("src").alias("above")), "id").select("id", "label", F.coalesce(F.try_element_at("metadata", F.lit("text")), F.lit("")).alias("text"), "above")


#: Entries of one JSON file of query sets.
SET = 256


@query("SELECT CAST(item_id AS VARCHAR) AS id, text AS query, item_id % 50 || ',' || item_id % 7 AS expected, 'd' || (item_id % 3) AS domain FROM benchmark")
def s10_query_set_round_trip(spark, read):
    """Retrieval queries as JSON files of about SET queries each, and read back."""
    items = read("benchmark")
    one = F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("query"), F.array((F.col("item_id") % 50).cast("string"), (F.col("item_id") % 7).cast("string")).alias("expected_articles"), F.expr("'d' || (item_id % 3)").alias("domain"))
    part = F.pmod(F.xxhash64("item_id"), F.lit(1 + items.count() // SET))
    files = items.groupBy(part.alias("part")).agg(F.to_json(F.struct(F.collect_list(one).alias("queries"))).alias("value"))
    files.write.partitionBy("part").text(path := _path(spark, "queries"))
    return readers.query_set(spark, f"{path}/*").select("id", "query", F.array_join("expected_articles", ",").alias("expected"), "domain")


@query("SELECT 'L' || o_custkey AS pcode, 'v' || o_orderkey AS version, '1' AS article_no, o_orderpriority AS text FROM orders WHERE o_orderkey % 5 > 0")
def s7_snapshot_files(spark, read):
    """The snapshots of all laws, a law a line, in files of many laws, and read back as rows; internal versions are left out."""
    key = F.concat(F.when(F.col("o_orderkey") % 5 == 0, "_").otherwise("v"), F.col("o_orderkey").cast("string"))
    versions = F.map_from_entries(F.collect_list(F.struct(key.alias("key"), F.create_map(F.lit("1"), "o_orderpriority").alias("value"))))
    laws = read("orders").groupBy(F.expr("'L' || o_custkey").alias("pcode")).agg(versions.alias("versions"))
    laws.write.json(path := _path(spark, "snapshots"))
    return readers.snapshot_lines(spark, path)
