"""Evaluation analytics, quotas, costs, and the general relational operations of the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.functions import vectors
from lexloom.streaming import feeds

from .registry import fixture, query, values

# ---- ablation: labels joined to documents ------------------------------------------------------

_LOG = "SELECT d.source AS condition, l.toxic, l.quality, d.n_chars FROM documents d JOIN labels l USING (doc_id)"


def _log(read):
    return read("documents").join(read("labels"), "doc_id").select(F.col("source").alias("condition"), "toxic", "quality", "n_chars")


@query(f"SELECT condition, count(*) AS total, concat(CAST(sum(toxic) AS BIGINT), '/', count(*), ' (', printf('%.1f', round_even(100.0 * sum(toxic) / count(*), 1)), '%)') AS marked, round_even(avg(n_chars), 0)::BIGINT AS avg_chars, round(avg(quality), 5) AS avg_quality FROM ({_LOG}) GROUP BY condition")
def a10_condition_stats(spark, read):
    """Per condition counts as k/n (p%), and averages."""
    k, n = F.sum("toxic"), F.count("*")
    marked = F.format_string("%d/%d (%.1f%%)", k, n, F.bround(100.0 * k / n, 1))
    return _log(read).groupBy("condition").agg(n.alias("total"), marked.alias("marked"), F.bround(F.avg("n_chars"), 0).cast("long").alias("avg_chars"), F.round(F.avg("quality"), 5).alias("avg_quality"))


@query(f"SELECT condition, count(*) AS total, count(*) FILTER (toxic = 1) AS fails, round_even(100.0 * count(*) FILTER (toxic = 1) / count(*), 2)::DOUBLE AS rate FROM ({_LOG}) GROUP BY condition")
def a16_fail_rates(spark, read):
    """Failures and rates to two decimals, half to even."""
    fails = F.count_if(F.col("toxic") == 1)
    return _log(read).groupBy("condition").agg(F.count("*").alias("total"), fails.alias("fails"), F.bround(100.0 * fails / F.count("*"), 2).alias("rate"))


_RATES = values("category, n, rates", "('a', 10, '0.5,0.2')", "('b', 7, '1,0')", "('c', 5, '0.9,0.9,0.9')")


@fixture("SELECT * FROM (VALUES ('a', 0.1::DOUBLE, 0.4::DOUBLE, 0.5::DOUBLE, 5::BIGINT), ('b', 0.0, 0.0, 1.0, 7), ('c', 0.729, 0.001, 0.27, 1)) t(category, all_fail, all_pass, mixed, expected)")
def a17_expectations(spark, read):
    """Products of rates, what is neither, and its expected number."""
    rows = spark.sql(f"SELECT * FROM {_RATES}").withColumn("p", F.transform(F.split("rates", ","), lambda x: x.cast("double")))
    rows = rows.withColumn("f", vectors.product(F.col("p"))).withColumn("g", vectors.product(F.transform("p", lambda x: 1.0 - x)))
    mixed = 1.0 - F.col("f") - F.col("g")
    return rows.select("category", F.round("f", 6).alias("all_fail"), F.round("g", 6).alias("all_pass"), F.round(mixed, 6).alias("mixed"), F.bround(F.round(mixed * F.col("n"), 6), 0).cast("long").alias("expected"))


_RUBRIC = values("doc, criterion, weight, score", "(1, 'a', 30, 90)", "(1, 'b', 70, 100)", "(2, 'a', 30, 50)", "(2, 'b', 70, 80)")


@fixture(f"SELECT doc, sum(weight * score) / 100.0::DOUBLE AS total FROM {_RUBRIC} GROUP BY doc")
def a24_rubric(spark, read):
    """Weighted rubric totals."""
    return spark.sql(f"SELECT * FROM {_RUBRIC}").groupBy("doc").agg((F.sum(F.col("weight") * F.col("score")) / 100.0).alias("total"))


@query("SELECT role, CAST(sum(trunc(0.25 * length(text))) AS BIGINT) AS tokens, round(sum(trunc(0.25 * length(text))) * 0.6 / 1000000, 6)::DOUBLE AS cost FROM conversations GROUP BY role")
def a25_token_costs(spark, read):
    """Tokens and their price."""
    tokens = F.sum((F.length("text") * 0.25).cast("long"))
    return read("conversations").groupBy("role").agg(tokens.alias("tokens"), F.round(tokens * 0.6 / 1000000, 6).alias("cost"))


_VARIABLES = values("doc, var, val", "(1, 'Amount', '100')", "(2, 'Amount', '200')", "(1, 'Court', 'x')", "(2, 'Court', 'x')", "(3, 'Rate', NULL)")


@fixture(f"SELECT var, string_agg(DISTINCT val, ',' ORDER BY val) AS vals FROM {_VARIABLES} GROUP BY var HAVING count(DISTINCT val) > 1")
def a26_inconsistent_variables(spark, read):
    """Variables with different values across documents."""
    rows = spark.sql(f"SELECT * FROM {_VARIABLES}")
    return rows.groupBy("var").agg(F.array_join(F.array_sort(F.collect_set("val")), ",").alias("vals"), F.count_distinct("val").alias("n")).where("n > 1").drop("n")


@query("SELECT event_type AS dimension, count(DISTINCT user_id % 7) AS members FROM events GROUP BY 1")
def a21_distinct_dimensions(spark, read):
    """Distinct members of a group."""
    return read("events").groupBy(F.col("event_type").alias("dimension")).agg(F.count_distinct(F.col("user_id") % 7).alias("members"))


@query("SELECT dimension, member AS typical FROM (SELECT event_type AS dimension, user_id % 7 AS member, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id % 7) AS place FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2) WHERE place = 1")
def a21_typical_dimension(spark, read):
    """The most common member of a group, the least of equally common ones."""
    return read("events").groupBy(F.col("event_type").alias("dimension")).agg(F.mode(F.col("user_id") % 7, deterministic=True).alias("typical"))


@query("SELECT doc_id, n FROM (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM documents) GROUP BY doc_id) WHERE n > 1")
def a13_duplicate_ids(spark, read):
    """Keys that occur more than once."""
    return read("labels").select("doc_id").union(read("documents").select("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")


# ---- quotas and windows ------------------------------------------------------------------------


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, user_id, count(*) AS used FROM events GROUP BY 1, 2")
def m8_daily_quota(spark, read):
    """Calls per day and user, by the function that also runs over a stream."""
    return feeds.daily_counts(read("events")).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("SELECT user_id, count(*) AS used, greatest(0, 150 - count(*)) AS remaining, 150 - count(*) <= 5 AS low, CAST(round_even(100.0 * count(*) / 150, 0) AS BIGINT) AS pct FROM events GROUP BY user_id")
def a23_quota_left(spark, read):
    """Used, left, whether little is left, and the percentage."""
    n = F.count("*")
    return read("events").groupBy("user_id").agg(n.alias("used"), F.greatest(F.lit(0), 150 - n).alias("remaining"), (150 - n <= 5).alias("low"), F.bround(100.0 * n / 150, 0).cast("long").alias("pct"))


@query("SELECT b AS start, event_type, count(*) AS calls FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS b FROM events) GROUP BY 1, 2")
def m9_rate_windows(spark, read):
    """M9: calls in sliding windows."""
    return feeds.sliding_counts(read("events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


# ---- health, previews, filters ------------------------------------------------------------------

_CHECKS = values("run, ok", "(1, true)", "(1, true)", "(2, true)", "(2, true)", "(2, true)", "(2, true)", "(2, false)", "(3, false)")


@fixture("SELECT * FROM (VALUES (1, 'green'), (2, 'yellow'), (3, 'red')) t(run, light)")
def r23_health(spark, read):
    """All passed, most passed, or not."""
    share = F.avg(F.col("ok").cast("int"))
    return spark.sql(f"SELECT * FROM {_CHECKS}").groupBy("run").agg(F.when(share == 1, "green").when(share >= 0.8, "yellow").otherwise("red").alias("light"))


_PREVIEW = values("id, a, b", "(1, 'abcdefghijklmnopqrstuvwxyz', 'abcdefghijklmnoXqrstuvwxyz')", "(2, 'same', 'same')", "(3, 'ab', 'abc')")


@fixture("SELECT * FROM (VALUES (1, 16, 'fghijklmnopqrstuvwxy'), (2, 0, ''), (3, 3, 'ab')) t(id, pos, around)")
def r26_diff_preview(spark, read):
    """The first place where two texts differ, with ten characters on either side."""
    return spark.sql(f"SELECT * FROM {_PREVIEW}").select("id", T.first_difference(F.col("a"), F.col("b")).alias("x")).select("id", "x.pos", "x.around")


_PLAN = values("condition, drops", "('full', '')", "('no citation', 'CITATION')", "('no core', 'ALL')")
_CORE = values("path", "('core/CITATION_POLICY')", "('core/ROLE')", "('core/GATE')")


@fixture(f"SELECT condition, path FROM {_PLAN}, {_CORE} WHERE drops <> 'ALL' AND (drops = '' OR NOT contains(path, drops))")
def r14_conditions(spark, read):
    """Each condition's load plan; ALL drops every core path. Both sides are literals."""
    both = spark.sql(f"SELECT * FROM {_PLAN}").crossJoin(spark.sql(f"SELECT * FROM {_CORE}"))
    return both.where("drops != 'ALL' AND (drops = '' OR NOT contains(path, drops))").select("condition", "path")


@fixture("SELECT reviewer, finding, count(*) OVER () AS n FROM (SELECT 'r1' AS reviewer, unnest(['a', 'b']) AS finding UNION ALL SELECT 'r2', unnest(['c']))")
def r25_findings(spark, read):
    """Findings of all reviewers, each with its reviewer."""
    rows = spark.sql("SELECT reviewer, explode(findings) AS finding FROM VALUES ('r1', array('a', 'b')), ('r2', array('c')) AS t(reviewer, findings)")
    return rows.withColumn("n", F.count("*").over(Window.partitionBy()))


# ---- general relational coverage -------------------------------------------------------------------

_YEAR = "CAST(strftime(o_orderdate, '%Y') AS INT)"


@query("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def g_pricing_summary(spark, read):
    """Scan, filter, aggregate; the filter and four columns reach the scan."""
    rows = read("lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE c_nationkey = s_nationkey GROUP BY n_name")
def g_local_supply(spark, read):
    """A five-way join."""
    rows = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(read("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query(f"SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(CAST({_YEAR} AS VARCHAR), 'all') AS year, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, {_YEAR})")
def g_rollup(spark, read):
    """Subtotals."""
    rows = read("orders").select("o_orderstatus", F.year("o_orderdate").cast("string").alias("y"))
    return rows.rollup("o_orderstatus", "y").agg(F.count("*").alias("n")).select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.coalesce("y", F.lit("all")).alias("year"), "n")


@query("SELECT coalesce(c_mktsegment, 'all') AS segment, coalesce(CAST(c_nationkey AS VARCHAR), 'all') AS nation, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
def g_cube(spark, read):
    """All groupings."""
    rows = read("customer").select("c_mktsegment", F.col("c_nationkey").cast("string").alias("k"))
    return rows.cube("c_mktsegment", "k").agg(F.count("*").alias("n")).select(F.coalesce("c_mktsegment", F.lit("all")).alias("segment"), F.coalesce("k", F.lit("all")).alias("nation"), "n")


@query("SELECT k, 'both' AS side FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'customers' FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def g_set_operations(spark, read):
    """Intersection, difference, union."""
    a, b = read("customer").select(F.col("c_nationkey").alias("k")), read("supplier").select("s_nationkey")
    return a.intersect(b).withColumn("side", F.lit("both")).union(a.subtract(b).withColumn("side", F.lit("customers")))


@query("SELECT o_orderkey, rank() OVER w AS place, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS running, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS quarter FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC)")
def g_windows(spark, read):
    """Ranks, running sums, quarters per customer."""
    by_date = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read("orders").select("o_orderkey", F.rank().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))).cast("long").alias("place"), F.round(F.sum("o_totalprice").over(by_date.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"), F.ntile(4).over(by_date).cast("long").alias("quarter"))
