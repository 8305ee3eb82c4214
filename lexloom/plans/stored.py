"""Tables and indexes that are written, changed and read back, and similar claims at the low threshold."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from lexloom.operators import graph, intervals, similarity, sketches, versions
from lexloom.operators.text_index import TrigramIndex, WordIndex
from lexloom.operators.vector_index import VectorIndex
from lexloom.sources import shared
from lexloom.sources.stored import Stored
from lexloom.streaming import feeds, tracker

from .committee import _COS, _EDGES, _graph
from .derived import Source
from .registry import query


@contextmanager
def _folder(spark, name: str):
    """A folder of the query's own; gone when its result is checkpointed."""
    path = f"{shared.folder(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        shared.drop(spark, path)


# ---- the vector index --------------------------------------------------------------------------

_BEST = "SELECT query_id, id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM (SELECT q.vec_id AS query_id, p.vec_id AS id, round({0}, 9) AS s FROM {1} q, {2} p WHERE q.vec_id % 100 = 0) QUALIFY rank <= 5"
_CHANGED = "(SELECT vec_id, CASE WHEN vec_id % 10 = 4 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS embedding FROM embeddings WHERE vec_id % 10 <> 3)"


def _vectors(read):
    e = read("embeddings")
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _shown(found):
    return found.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_BEST.format(_COS, "embeddings", "embeddings"))
def t2_index_search(spark, read):
    """An inverted-file index of all vectors, searched in all its cells."""
    queries, points = _vectors(read)
    with _folder(spark, "index") as path:
        return shared.checkpoint(_shown(VectorIndex(spark, path).build(points).search(queries, 5)))


@query(_BEST.format(_COS, "embeddings", _CHANGED))
def t2_index_changes(spark, read):
    """A tenth of the points deleted, a tenth replaced; a search of few cells that goes on until no other cell can be better."""
    queries, points = _vectors(read)
    with _folder(spark, "index") as path:
        index = VectorIndex(spark, path).build(points)
        index.delete(points.where("id % 10 = 3").select("id"))
        index.upsert(points.where("id % 10 = 4").select("id", F.transform("v", lambda x: -x).alias("v")))
        return shared.checkpoint(_shown(index.search(queries, 5, probes=4, exact=True)))


# ---- changes to a stored table -----------------------------------------------------------------

_TRACKED = Source("documents", "doc_id AS pcode", "source AS name", "lang AS level", "CAST(n_chars % 28 AS INT) AS days")


@query(f"""SELECT pcode, name, level, CASE WHEN days > 20 THEN 1 ELSE days END AS days FROM (
SELECT pcode, CASE WHEN pcode % 6 = 0 THEN 'new ' || name ELSE name END AS name, CASE WHEN pcode % 6 = 0 THEN NULL WHEN pcode % 2 = 0 THEN level ELSE 'late' END AS level, days FROM {_TRACKED}) WHERE level IS NULL OR level <> 'de'""")
def m1_stored_changes(spark, read):
    """M1, M2, M3: rows of a stored table ignored if known, replaced, updated and deleted, each as one commit."""
    rows = _TRACKED(read)
    with _folder(spark, "tracked") as path:
        table = Stored(spark, path, rows.schema, ["pcode"])
        table.insert_ignore(rows.where("pcode % 2 = 0"))
        table.insert_ignore(rows.withColumn("level", F.lit("late")))
        table.replace(rows.where("pcode % 6 = 0").select("pcode", F.concat(F.lit("new "), "name").alias("name"), F.lit(None).cast("string").alias("level"), "days"))
        table.update("days > 20", {"days": F.lit(1)})
        table.delete("level = 'de'")
        return shared.checkpoint(table.rows())


@query(f"SELECT 'first' AS change, count(*) FILTER (pcode % 2 = 0) AS n FROM {_TRACKED} UNION ALL SELECT 'second', count(*) FILTER (pcode % 2 <> 0) FROM {_TRACKED} UNION ALL SELECT 'replaced', count(*) FILTER (pcode % 6 = 0) FROM {_TRACKED} UNION ALL SELECT 'deleted', count(*) FILTER (pcode % 5 = 0) FROM {_TRACKED} UNION ALL SELECT 'none', 0 UNION ALL SELECT 'left', count(*) FILTER (pcode % 5 <> 0) FROM {_TRACKED}")
def m3_change_counts(spark, read):
    """M1, M3: how many rows each change met."""
    rows = _TRACKED(read)
    with _folder(spark, "tracked") as path:
        table = Stored(spark, path, rows.schema, ["pcode"])
        done = [("first", table.insert_ignore(rows.where("pcode % 2 = 0"))), ("second", table.insert_ignore(rows)), ("replaced", table.replace(rows.where("pcode % 6 = 0"))), ("deleted", table.delete("pcode % 5 = 0")), ("none", table.delete("pcode < 0"))]
        return spark.createDataFrame([*done, ("left", table.rows().count())], "change string, n long")


# ---- similar claims ----------------------------------------------------------------------------

#: A third of all claims are in dimension 0. The texts are of decimal digits and five letters, so that the oracle can hold a set as bits.
_CLAIMS = Source("orders", "o_orderkey AS id", "CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey END AS dimension", "CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE (o_orderkey * 37 % 10007) || '-' || o_orderstatus || (o_custkey % 100) END AS issue")
_BITS = f"SELECT id, dimension, list_aggregate(list_transform(list_distinct(string_split(lower(left(issue, 40)), '')), lambda x: 1::BIGINT << strpos('0123456789-fop', x)), 'bit_or') AS s FROM {_CLAIMS} WHERE issue IS NOT NULL"
_SETS = f"SELECT dimension, s, count(*) AS n, min(id) AS least FROM ({_BITS}) GROUP BY 1, 2"
_LINKED = "a.dimension = b.dimension AND a.s <> b.s AND bit_count(a.s & b.s)::DOUBLE / bit_count(a.s | b.s) > 0.35"


@query(f"WITH c AS ({_SETS}), l AS (SELECT a.dimension, a.s, sum(b.n)::BIGINT AS links FROM c a JOIN c b ON {_LINKED} GROUP BY 1, 2) SELECT i.id, CASE WHEN b.s IS NULL THEN 0 ELSE coalesce(l.links, 0) + c.n - 1 END AS links FROM {_CLAIMS} i LEFT JOIN ({_BITS}) b USING (id) LEFT JOIN c ON c.dimension = b.dimension AND c.s = b.s LEFT JOIN l ON l.dimension = b.dimension AND l.s = b.s")
def j11_linked_claims(spark, read):
    """With how many claims of its dimension each claim shares more than 35 percent of its characters; one dimension holds a third of all claims."""
    return similarity.of_claims(_CLAIMS(read)).select("id", "links")


# ---- the tracking run as a stream --------------------------------------------------------------

_INDEX = Source("orders", "'L' || o_custkey AS pcode", "o_orderdate AS seen", "CAST(10000 + o_orderkey % 9973 AS VARCHAR(5)) AS current", "o_orderkey % 11 = 0 AS abolished")
_DAYS = f"SELECT pcode, CAST(date_trunc('day', seen) AS TIMESTAMP) AS seen, max(current) AS current, bool_or(abolished) AS abolished FROM {_INDEX} GROUP BY 1, 2"


@query(f"""WITH d AS ({_DAYS}), r AS (SELECT *, max(CASE WHEN NOT abolished THEN current END) OVER (PARTITION BY pcode ORDER BY seen ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old, lead(seen) OVER (PARTITION BY pcode ORDER BY seen) AS next FROM d)
SELECT pcode, strftime(seen, '%Y%m%d') AS at, old AS old_version, current AS new_version, CASE WHEN abolished THEN 'abolished' WHEN old IS NULL THEN 'newly_tracked' WHEN current > old THEN 'changed' ELSE 'unchanged' END AS status FROM r
UNION ALL SELECT pcode, strftime(seen + INTERVAL 180 DAY, '%Y%m%d'), greatest(old, CASE WHEN NOT abolished THEN current END), NULL, 'missing' FROM r WHERE seen + INTERVAL 180 DAY < coalesce(next, (SELECT max(seen) - INTERVAL 1 DAY FROM d))""")
def m5_tracking_stream(spark, read):
    """M5, M6, M7: all orders as index rows that arrive in three drops, with a restart of the tracking stream between them."""
    rows = _INDEX(read)
    with _folder(spark, "tracking") as path:
        for low, high in (("0001", "1994"), ("1994", "1996"), ("1996", "9999")):
            rows.where((F.date_format("seen", "yyyy") >= low) & (F.date_format("seen", "yyyy") < high)).write.mode("append").parquet(f"{path}/in")
            tracker.run(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), f"{path}/out", f"{path}/state").awaitTermination()
        found = tracker.found(spark, f"{path}/out")
        return shared.checkpoint(found.select("pcode", F.date_format("at", "yyyyMMdd").alias("at"), "old_version", "new_version", "status"))


# ---- validity intervals ------------------------------------------------------------------------

#: Versions of a law last until the next one; periods are asked for. One law in fifty is law 0, with as many versions as all of these.
_VERSIONS = "SELECT law, day AS start, lead(day) OVER (PARTITION BY law ORDER BY day) AS \"end\" FROM (SELECT DISTINCT CASE WHEN o_custkey % 50 = 0 THEN 0 ELSE o_custkey END AS law, CAST(o_orderdate AS DATE) AS day FROM orders)"
_PERIODS = "SELECT CASE WHEN o_custkey % 50 = 0 THEN 0 ELSE o_custkey END AS law, o_orderkey AS asked, CAST(o_orderdate AS DATE) - CAST(o_orderkey % 90 AS INT) AS start, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 7 * (o_orderkey % 7) * 5 AS INT) AS \"end\" FROM orders WHERE o_orderkey % 3 = 0"


@query(f"SELECT p.law, p.asked, count(*) AS versions, strftime(min(v.start), '%Y%m%d') AS first, strftime(max(v.start), '%Y%m%d') AS last, sum(least(coalesce(v.\"end\", p.\"end\"), p.\"end\") - greatest(v.start, p.start))::BIGINT AS days FROM ({_VERSIONS}) v JOIN ({_PERIODS}) p ON v.law = p.law AND v.start < p.\"end\" AND p.start < coalesce(v.\"end\", DATE '9999-01-01') GROUP BY 1, 2")
def j5_validity_periods(spark, read):
    """J5 for periods: which versions of a law were in force in each period asked for, and for how many days."""
    o = read("orders").select(F.expr("CASE WHEN o_custkey % 50 = 0 THEN 0 ELSE o_custkey END AS law"), F.col("o_orderdate").cast("date").alias("day"), "o_orderkey")
    versions = o.select("law", "day").distinct().selectExpr("law", "day AS start", "lead(day) OVER (PARTITION BY law ORDER BY day) AS end")
    periods = o.where("o_orderkey % 3 = 0").selectExpr("law", "o_orderkey AS asked", "date_sub(day, CAST(o_orderkey % 90 AS INT)) AS start", "date_add(day, CAST(o_orderkey % 7 * (o_orderkey % 7) * 5 AS INT)) AS end")
    met = intervals.overlapping(versions, periods, ["law"])
    days = F.datediff(F.least(F.coalesce("l.end", "r.end"), "r.end"), F.greatest("l.start", "r.start"))
    shown = lambda c: F.date_format(c, "yyyyMMdd")
    return met.groupBy("law", F.col("r.asked").alias("asked")).agg(F.count("*").alias("versions"), shown(F.min("l.start")).alias("first"), shown(F.max("l.start")).alias("last"), F.sum(days).alias("days"))


# ---- hashes that follow each other, and paths ---------------------------------------------------

@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, event_id || ':' || event_type AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
c AS (SELECT user_id, event_id, k, '' AS prev_hash, sha256('|' || p) AS hash FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, c.hash, sha256(c.hash || '|' || e.p) FROM c JOIN e ON e.user_id = c.user_id AND e.k = c.k + 1)
SELECT user_id, event_id, hash, prev_hash FROM c""")
def w7_linked_hashes(spark, read):
    """A chain of hashes for each user, each of the one before and the event."""
    rows = read("events").select("user_id", "ts", "event_id", F.concat_ws(":", F.col("event_id").cast("string"), "event_type").alias("payload"))
    return versions.linked_hashes(rows, "user_id", ["ts", "event_id"], "payload").select("user_id", "event_id", "hash", "prev_hash")


@query(f"""WITH RECURSIVE e AS (SELECT src, dst FROM ({_EDGES}) WHERE src <> dst), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
w AS (SELECT id AS start, id, 0 AS d, [id] AS p FROM (SELECT 'r' || r_regionkey AS id FROM region) UNION ALL SELECT w.start, b.dst, d + 1, list_append(p, b.dst) FROM w JOIN b ON b.src = w.id WHERE d < 3 AND NOT list_contains(p, b.dst))
SELECT start, id, d AS depth, array_to_string(p, '>') AS path FROM (SELECT *, row_number() OVER (PARTITION BY start, id ORDER BY d, list_reverse(p)) AS n FROM w) WHERE n = 1 AND d > 0""")
def g6_shortest_paths(spark, read):
    """One shortest path from each region to every entity within three hops, over edges in either direction."""
    nodes, edges = _graph(read)
    found = graph.shortest_paths(edges, nodes.where("type = 'Part'").select("id"), 3)
    return found.select("start", "id", "depth", F.array_join("path", ">").alias("path"))


# ---- text search -------------------------------------------------------------------------------

_NAMES = "SELECT 'p' || p_partkey AS id, p_name AS text FROM part UNION ALL SELECT 'c' || c_custkey, c_name FROM customer UNION ALL SELECT 'u' || page_id, url FROM pages"
_WORDS = "SELECT 'b' || item_id AS word_id, lower(substr(text, 3, 1 + CAST(item_id % 4 AS INT))) AS word FROM benchmark UNION ALL SELECT 'n' || n_nationkey, '/' || n_nationkey FROM nation UNION ALL SELECT 's' || s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '0' || s_suppkey WHEN 1 THEN 'rin' ELSE 'no such ' || s_suppkey END FROM supplier"


@query(f"SELECT word_id, count(*) AS texts, min(id) AS first, max(id) AS last FROM ({_WORDS}) w JOIN ({_NAMES}) n ON contains(n.text, w.word) WHERE word <> '' GROUP BY 1")
def p2_trigram_search(spark, read):
    """Parts, customers and pages whose name or address contains each of many search words."""
    names = read("part").selectExpr("'p' || p_partkey AS id", "p_name AS text").union(read("customer").selectExpr("'c' || c_custkey", "c_name")).union(read("pages").selectExpr("'u' || page_id", "url"))
    wanted = read("benchmark").selectExpr("'b' || item_id AS word_id", "lower(substr(text, 3, 1 + CAST(item_id % 4 AS INT))) AS word").union(read("nation").selectExpr("'n' || n_nationkey", "'/' || n_nationkey"))
    wanted = wanted.union(read("supplier").selectExpr("'s' || s_suppkey", "CASE s_suppkey % 3 WHEN 0 THEN '0' || s_suppkey WHEN 1 THEN 'rin' ELSE 'no such ' || s_suppkey END"))
    with _folder(spark, "trigrams") as path:
        return shared.checkpoint(TrigramIndex(spark, path).build(names).counted(wanted))


_CUT = r"list_filter(regexp_split_to_array(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\x{{80}}-\x{{10FFFF}}]+'), lambda x: x <> '')"
_SAID = "conv_id * 100000 + turn AS id"
_ASKED = "regexp_extract(text, '^(?:[^ ]+ ){5}([^ ]+ [^ ]+ [^ ]+)', 1)"
_BM25 = f"""WITH d AS (SELECT {_SAID}, {_CUT.format('text')} AS w FROM conversations), l AS (SELECT id, len(w) AS n FROM d), t AS (SELECT id, w, count(*) AS tf FROM (SELECT id, unnest(w) AS w FROM d) GROUP BY 1, 2),
q AS (SELECT DISTINCT item_id AS query_id, unnest({_CUT.format(_ASKED)}) AS w FROM benchmark), f AS (SELECT w, count(*) AS df FROM t GROUP BY 1), m AS (SELECT count(*) AS n, avg(n) AS mean FROM l)
SELECT query_id, t.id, round(sum(ln(1 + (m.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l.n / m.mean))), 9) AS s FROM q JOIN t USING (w) JOIN f USING (w) JOIN l ON l.id = t.id, m GROUP BY 1, 2"""


@query(f"SELECT query_id, id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM ({_BM25}) QUALIFY rank <= 10")
def s24_ranked_search(spark, read):
    """The ten turns of conversations of the highest BM25 for three words of each benchmark item."""
    asked = read("benchmark").select(F.col("item_id").alias("query_id"), F.expr(_ASKED).alias("query"))
    with _folder(spark, "words") as path:
        found = WordIndex(spark, path).build(read("conversations").selectExpr(_SAID, "text")).search(asked, 10)
        return shared.checkpoint(found.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank")))


_TWO = "regexp_extract(text, '^(?:[^ ]+ ){2}([^ ]+ [^ ]+)', 1)"


@query(f"""WITH d AS (SELECT {_SAID}, ' ' || array_to_string({_CUT.format('text')}, '  ') || ' ' AS w FROM conversations), q AS (SELECT item_id AS query_id, {_CUT.format(_TWO)} AS p FROM benchmark)
SELECT query_id, count(*) AS texts, sum(n)::BIGINT AS times FROM (SELECT query_id, id, (length(w) - length(replace(w, ' ' || array_to_string(p, '  ') || ' ', ''))) // (length(array_to_string(p, '  ')) + 2) AS n FROM d, q WHERE len(p) = 2 AND p[1] <> p[2]) WHERE n > 0 GROUP BY 1""")
def s24_phrases(spark, read):
    """Turns with a phrase of two words of each benchmark item, and how often."""
    asked = read("benchmark").select(F.col("item_id").alias("query_id"), F.expr(_TWO).alias("phrase"))
    words = F.filter(F.split(F.translate("phrase", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda x: x != "")
    asked = asked.where((F.size(words) == 2) & (F.get(words, F.lit(0)) != F.get(words, F.lit(1))))
    with _folder(spark, "words") as path:
        found = WordIndex(spark, path).build(read("conversations").selectExpr(_SAID, "text")).phrases(asked)
        return shared.checkpoint(found.groupBy("query_id").agg(F.count("*").alias("texts"), F.sum("times").alias("times")))


# ---- sessions, and calls that follow others, as streams ------------------------------------------

_GAPS = "SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)"


def _streamed(spark, events, path, query):
    """What a streaming query over the events gives that arrive in two drops by time, with a restart, and one more event long after all."""
    cut = events.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    last = events.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts")).select(*[F.col("ts") if f.name == "ts" else F.lit(-1).cast(f.dataType).alias(f.name) if f.dataType.simpleString() != "string" else F.lit("last").alias(f.name) for f in events.schema])
    middle = events.where(F.col("event_id") == cut).agg(F.max("ts").alias("middle"))
    halves = events.join(F.broadcast(middle))
    for drop in (halves.where("ts <= middle").drop("middle"), halves.where("ts > middle").drop("middle"), last.withColumn("event_type", F.lit("view")).unionByName(last.withColumn("event_type", F.lit("purchase")))):
        drop.write.mode("append").parquet(f"{path}/in")
        feeds.append(query(spark.readStream.schema(events.schema).parquet(f"{path}/in")), f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.option("basePath", f"{path}/out").parquet(f"{path}/out/batch=*").where("user_id >= 0").drop("batch")


@query(f"SELECT user_id, strftime(min(ts), '%Y%m%d%H%M%S') AS start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y%m%d%H%M%S') AS until, count(*) AS calls FROM ({_GAPS}) GROUP BY user_id, k")
def m9_sessions_stream(spark, read):
    """M9, 2.11: calls of a user that follow each other within six hours, from a stream with a restart."""
    with _folder(spark, "sessions") as path:
        found = _streamed(spark, read("events"), path, lambda e: feeds.sessions(e, "6 hours"))
        return shared.checkpoint(found.select("user_id", F.date_format("start", "yyyyMMddHHmmss").alias("start"), F.date_format("end", "yyyyMMddHHmmss").alias("until"), "calls"))


@query("SELECT a.user_id, a.event_id, b.event_id AS then_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 12 HOUR")
def m9_followed_stream(spark, read):
    """M9, 2.11: views with each purchase by the same user within twelve hours, as a join of two streams with a restart."""
    both = lambda e: feeds.followed(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "12 hours")
    with _folder(spark, "followed") as path:
        return shared.checkpoint(_streamed(spark, read("events"), path, both).select("user_id", "event_id", "then_id"))


# ---- sketches that merge -------------------------------------------------------------------------

@query("SELECT event_type, strftime(ts, '%Y%m') AS period, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_fit, true AS median_fits FROM events GROUP BY 1, 2")
def a1_merged_sketches(spark, read):
    """A1, A2, 2.4: sketches by day merged to months; whether the estimates beside the exact counts are within their bounds."""
    rows = read("events").withColumn("d", F.date_format("ts", "yyyyMMdd"))
    month = F.substring("d", 1, 6).alias("period")
    months = sketches.merged(sketches.daily(rows, "d", ["event_type"], "user_id", "event_id"), ["event_type"], F.substring("day", 1, 6))
    months = months.select("event_type", "period", "n", sketches.members("members").alias("about"), sketches.quantile("spread", 0.5).alias("median"))
    joined = rows.withColumn("period", month).join(F.broadcast(months.select("event_type", "period", "median")), ["event_type", "period"])
    exact = joined.groupBy("event_type", "period").agg(F.count_distinct("user_id").alias("users"), F.count_if(F.col("event_id") < F.col("median")).alias("below"), F.count_if(F.col("event_id") <= F.col("median")).alias("upto"))
    fits = F.abs(F.col("about") - F.col("users")) <= sketches.ERROR * F.col("users") + 1
    middle = (F.col("below") <= (0.5 + sketches.RANK) * F.col("n") + 1) & (F.col("upto") >= (0.5 - sketches.RANK) * F.col("n") - 1)
    return months.join(exact, ["event_type", "period"]).select("event_type", "period", "n", "users", fits.alias("users_fit"), middle.alias("median_fits"))
