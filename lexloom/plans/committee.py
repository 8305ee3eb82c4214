"""Reviewers, graphs, retrieval: inventory groups on claims, clusters, traversal and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.operators import consensus as C
from lexloom.operators import graph as G
from lexloom.operators import retrieval as R

from .registry import fixture, query, values

# ---- claims of models on articles: events as answers ----------------------------------------

_CLAIMS = "SELECT user_id AS ref, 'm' || CAST(event_id % 3 AS VARCHAR) AS model, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS status FROM events"


def _claims(read):
    status = F.when(F.col("event_id") % 7 != 0, F.col("event_type"))
    return read("events").select(F.col("user_id").alias("ref"), F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("model"), status.alias("status"))


_CLUSTERS = f"SELECT ref, string_agg(DISTINCT model, ',' ORDER BY model) AS models, coalesce(string_agg(DISTINCT status, ',' ORDER BY status), '') AS statuses, count(DISTINCT status) AS n_statuses, count(*) AS n_claims, CASE WHEN count(DISTINCT status) <= 1 THEN 'consensus' ELSE 'disagreement' END AS label FROM ({_CLAIMS}) GROUP BY ref"


@query(_CLUSTERS)
def a4_claim_clusters(spark, read):
    """Claims on one reference, who makes them, and whether they agree."""
    return C.clusters(_claims(read), ["ref"])


@query(f"WITH h AS (SELECT DISTINCT ref, model, status FROM ({_CLAIMS}) WHERE status IS NOT NULL) SELECT a.ref, a.model AS model_a, a.status AS position_a, b.model AS model_b, b.status AS position_b FROM h a JOIN h b ON a.ref = b.ref AND a.model < b.model AND a.status <> b.status")
def j9_disagreements(spark, read):
    """Pairs of models with different positions in a cluster."""
    return C.disagreements(_claims(read), ["ref"]).select("ref", "model_a", "position_a", "model_b", "position_b")


@query(f"SELECT ref, count(DISTINCT model) AS models FROM ({_CLAIMS}) WHERE status IN ('purchase', 'click') GROUP BY ref HAVING count(DISTINCT model) >= 2")
def a5_blind_spots(spark, read):
    """References that at least two models call invalid."""
    return C.blind_spots(_claims(read), ["ref"], ("purchase", "click"))


@query(f"SELECT count(*) AS clusters, count(*) FILTER (label = 'consensus') AS consensus, count(*) FILTER (label = 'disagreement') AS disagreement, bool_or(label = 'disagreement') AS any_disagreement, bool_and(n_claims > 0) AS all_claimed, sum(n_claims) AS claims FROM ({_CLUSTERS})")
def a6_report_counters(spark, read):
    """The counters of a report."""
    c = C.clusters(_claims(read), ["ref"])
    return c.agg(F.count("*").alias("clusters"), F.count_if(F.col("label") == "consensus").alias("consensus"), F.count_if(F.col("label") == "disagreement").alias("disagreement"), F.bool_or(F.col("label") == "disagreement").alias("any_disagreement"), F.bool_and(F.col("n_claims") > 0).alias("all_claimed"), F.sum("n_claims").alias("claims"))


_ANSWERS = values("query_id, model, text", "('q1', 'model-a', '§987 已刪除，§9999 不存在')", "('q1', 'model-b', '第987條已廢止，第9999條查無')", "('q1', 'model-c', '§987 已刪除')", "('q2', 'model-a', '第1條之規定與第1條')", "('q2', 'model-b', '')")


@fixture("SELECT * FROM (VALUES ('q1', 'model-a', 0, 'general', NULL), ('q1', 'model-b', 0, '民法第987條', 'deleted'), ('q1', 'model-b', 1, '民法第9999條', 'deleted'), ('q1', 'model-c', 0, 'general', NULL), ('q2', 'model-a', 0, '民法第1條', NULL), ('q2', 'model-a', 1, '民法第1條', NULL), ('q2', 'model-b', 0, 'general', NULL)) t(query_id, model, pos, article_ref, status)")
def f18_claims_of_answers(spark, read):
    """answers as claims; repeated references stay, answers without one are one general claim."""
    return C.claims(spark.sql(f"SELECT * FROM {_ANSWERS}"))


@fixture("SELECT * FROM (VALUES ('q1', 'general', 'model-a,model-c', 'consensus'), ('q1', '民法第987條', 'model-b', 'consensus'), ('q1', '民法第9999條', 'model-b', 'consensus'), ('q2', 'general', 'model-b', 'consensus'), ('q2', '民法第1條', 'model-a', 'consensus')) t(query_id, article_ref, models, label)")
def l5_committee_clusters(spark, read):
    """Answers to claims to clusters, for all queries in one job."""
    return C.clusters(C.claims(spark.sql(f"SELECT * FROM {_ANSWERS}")), ["query_id", "article_ref"]).select("query_id", "article_ref", "models", "label")


_ISSUES = values(
    "id, dimension, reviewer, severity, issue", "(1, 'clarity', 'r1', 'minor', 'abcdefgh ij')", "(2, 'clarity', 'r2', 'critical', 'ABCDEFGHIK')", "(3, 'clarity', 'r3', 'major', 'ijkab cdefg')",
    "(4, 'clarity', 'r1', 'minor', 'zzyyxx')", "(5, 'safety', 'r1', 'major', 'abcdefghij')", "(6, 'structure', 'r2', 'minor', '')",
)
_LABELS = "SELECT * FROM (VALUES (1, 3, 3, 'consensus', 'critical', 'auto_fix', 1), (4, 1, 1, 'unique_insight', 'minor', 'verify_apply', 2), (5, 1, 1, 'unique_insight', 'major', 'verify_apply', 2), (6, 1, 1, 'unique_insight', 'minor', 'verify_apply', 2)) t(component, n_claims, reviewers, label, severity, action, priority)"


@fixture("SELECT * FROM (VALUES (1, 2), (1, 3), (2, 3)) t(a, b)")
def j11_similar_claims(spark, read):
    """Claims of one dimension whose beginnings share their characters."""
    return C.similar_claims(spark.sql(f"SELECT * FROM {_ISSUES}"))


@fixture(_LABELS)
def r4_issue_components(spark, read):
    """Similar claims to components, their label, gravest severity and action."""
    rows = spark.sql(f"SELECT * FROM {_ISSUES}")
    comp = C.connected(rows.select("id"), C.similar_claims(rows))
    worst = F.max_by("severity", C.severity_rank(F.col("severity")))
    out = rows.join(comp, "id").groupBy("component").agg(F.count("*").cast("int").alias("n_claims"), F.count_distinct("reviewer").cast("int").alias("reviewers"), worst.alias("severity"))
    out = out.withColumn("label", F.when(F.col("reviewers") >= 2, "consensus").otherwise("unique_insight")).withColumn("act", C.action(F.col("label")))
    return out.select("component", "n_claims", "reviewers", "label", "severity", "act.action", "act.priority").orderBy("priority", "component")


@fixture(f"SELECT d.dimension FROM (VALUES ('clarity'), ('safety'), ('structure'), ('scope')) d(dimension) WHERE d.dimension NOT IN (SELECT dimension FROM {_ISSUES})")
def r5_uncovered_dimensions(spark, read):
    """Expected dimensions that no claim covers."""
    expected = spark.sql("SELECT * FROM VALUES ('clarity'), ('safety'), ('structure'), ('scope') AS d(dimension)")
    return expected.join(spark.sql(f"SELECT * FROM {_ISSUES}"), "dimension", "left_anti")


@query("SELECT component, count(*) AS docs FROM (SELECT least(c_custkey, c_nationkey + 1000000) AS x, c_nationkey AS component FROM customer) GROUP BY component")
def g9_nation_components(spark, read):
    """G9 at scale: customers and nations as one graph; each component is a nation's."""
    edges = read("customer").select((F.col("c_custkey") + 1000).alias("a"), F.col("c_nationkey").cast("long").alias("b"))
    nodes = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    return C.connected(nodes, edges).where("id >= 1000").groupBy("component").agg(F.count("*").alias("docs")).select(F.col("component").cast("int").alias("component"), "docs")


_PROVIDERS = values("q, provider, priority, ok, text", "('a', 'p1', 1, true, '" + "共同內容" * 15 + "甲')", "('a', 'p2', 2, true, '乙" + "共同內容" * 15 + "')", "('b', 'p1', 1, false, NULL)", "('b', 'p2', 2, true, 'x')", "('c', 'p1', 1, false, NULL)", "('d', 'p1', 1, true, 'abc')", "('d', 'p2', 2, true, 'xbc')")


@fixture("SELECT * FROM (VALUES ('a', 2, 60, 'consensus', 'p1'), ('b', 1, 1, 'dissensus', 'p2'), ('c', 0, 0, 'blind_spot', NULL), ('d', 2, 2, 'dissensus', 'p1')) t(q, valid, shared, verdict, first)")
def l4_provider_verdicts(spark, read):
    """First success by priority, longest passage in common, verdict."""
    from lexloom.functions.udfs import common_fragment

    rows = spark.sql(f"SELECT * FROM {_PROVIDERS}")
    good = F.when(F.col("ok"), F.struct("priority", "provider", "text"))
    rows = rows.groupBy("q").agg(F.array_sort(F.collect_list(good)).alias("g")).withColumn("valid", F.size("g"))
    rows = rows.withColumn("fragment", common_fragment(F.transform("g", lambda x: x["text"])))
    return rows.select("q", "valid", F.length("fragment").alias("shared"), C.verdict(F.col("valid"), F.col("fragment")).alias("verdict"), F.get("g", F.lit(0))["provider"].alias("first"))


_CONFIDENCES = values("id, number, text", "(1, CAST(0.8 AS DOUBLE), NULL)", "(2, CAST(1.7 AS DOUBLE), NULL)", "(3, NULL, '80%')", "(4, NULL, '0.8')", "(5, NULL, NULL)", "(6, NULL, 'high')", "(7, CAST(-1 AS DOUBLE), NULL)")


@fixture(f"SELECT id, round(coalesce(greatest(0.0, least(1.0, coalesce(number, TRY_CAST(replace(text, '%', '') AS DOUBLE) / 100))), 0.8), 6)::DOUBLE AS confidence FROM {_CONFIDENCES}")
def f49_confidences(spark, read):
    """confidences clamped; texts are percentages; a default."""
    return spark.sql(f"SELECT * FROM {_CONFIDENCES}").select("id", F.round(C.confidence(F.col("number"), F.col("text")), 6).alias("confidence"))


# ---- graph: region has nations, nations have customers; customers refer to suppliers of their nation

_EDGES = "SELECT 'r' || r_regionkey AS src, 'n' || n_nationkey AS dst, 'has_part' AS type FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'has_part' FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'references' FROM supplier"
_NODES = "SELECT 'r' || r_regionkey AS id, r_name AS label, 'Part' AS type FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'Chapter' FROM nation UNION ALL SELECT 'c' || c_custkey, c_name, 'Article' FROM customer UNION ALL SELECT 's' || s_suppkey, s_name, 'Concept' FROM supplier"


def _graph(read):
    def key(letter, column):
        return F.concat(F.lit(letter), F.col(column).cast("string"))

    edges = read("nation").select(key("r", "n_regionkey").alias("src"), key("n", "n_nationkey").alias("dst"), F.lit("has_part").alias("type"))
    edges = edges.unionByName(read("customer").select(key("n", "c_nationkey").alias("src"), key("c", "c_custkey").alias("dst"), F.lit("has_part").alias("type")))
    edges = edges.unionByName(read("supplier").select(key("n", "s_nationkey").alias("src"), key("s", "s_suppkey").alias("dst"), F.lit("references").alias("type")))
    nodes = None
    for t, k, name, letter, kind in (("region", "r_regionkey", "r_name", "r", "Part"), ("nation", "n_nationkey", "n_name", "n", "Chapter"), ("customer", "c_custkey", "c_name", "c", "Article"), ("supplier", "s_suppkey", "s_name", "s", "Concept")):
        one = read(t).select(key(letter, k).alias("id"), F.col(name).alias("label"), F.lit(kind).alias("type"))
        nodes = one if nodes is None else nodes.unionByName(one)
    return nodes, edges


@query(f"WITH e AS ({_EDGES}) SELECT src AS id, dst AS other, type, 'out' AS direction FROM e UNION ALL SELECT dst, src, min(type), 'in' FROM e WHERE src <> dst GROUP BY dst, src")
def p6_relations(spark, read):
    """Out-edges, and one in-edge per source; for all entities."""
    return G.relations(_graph(read)[1])


@query(f"SELECT dst AS id, src AS other FROM ({_EDGES}) WHERE type IN ('is_a', 'has_part')")
def g2_upstream(spark, read):
    """One hop up the hierarchy."""
    return G.neighbours(_graph(read)[1], up=True)


@query(f"WITH RECURSIVE e AS ({_EDGES}), h AS (SELECT DISTINCT src, dst FROM e WHERE type = 'has_part'), w AS (SELECT id AS start, id, 0 AS depth FROM (SELECT 'r' || r_regionkey AS id FROM region) UNION ALL SELECT w.start, h.dst, w.depth + 1 FROM w JOIN h ON h.src = w.id WHERE w.depth < 2) SELECT start, id, min(depth) AS depth FROM w WHERE depth > 0 GROUP BY 1, 2")
def g4_descend(spark, read):
    """Everything within two hops down, each at its least depth."""
    nodes, edges = _graph(read)
    return G.reach(edges, nodes.where("type = 'Part'").select("id"), 2, up=False)


@query(f"WITH e AS ({_EDGES}), v AS ({_NODES}) SELECT n.id AS start, n.label, coalesce((SELECT string_agg(v.label, ',' ORDER BY v.label) FROM e JOIN v ON v.id = e.src WHERE e.dst = n.id AND e.type = 'has_part'), '') AS above, (SELECT count(DISTINCT e.dst) FROM e WHERE e.src = n.id AND e.type = 'has_part') AS n_below, (SELECT count(DISTINCT e.dst) FROM e WHERE e.src = n.id AND e.type = 'references') AS n_refs FROM v n WHERE n.type = 'Chapter'")
def g5_context(spark, read):
    """What stands above, below and is referenced."""
    nodes, edges = _graph(read)
    c = G.context(nodes, edges, nodes.where("type = 'Chapter'").select("id"), depth=1, lists=("above",))
    return c.select("start", "label", F.array_join("above", ",").alias("above"), "n_below", "n_refs")


@query(f"WITH e AS ({_EDGES}), v AS ({_NODES}) SELECT c.id AS start, r.label || ' → ' || c.label AS path FROM v c JOIN e ON e.dst = c.id AND e.type = 'has_part' JOIN v r ON r.id = e.src WHERE c.type = 'Article'")
def g6_paths(spark, read):
    """Label paths."""
    nodes, edges = _graph(read)
    return G.context(nodes, edges, nodes.where("type = 'Article'").select("id"), depth=1).select("start", "path")


@query(f"SELECT type, count(*) AS n, (SELECT count(*) FROM ({_EDGES})) AS edges FROM ({_NODES}) GROUP BY type")
def a14_graph_counts(spark, read):
    """Nodes by type, and edges."""
    nodes, edges = _graph(read)
    return nodes.groupBy("type").agg(F.count("*").alias("n")).crossJoin(F.broadcast(edges.agg(F.count("*").alias("edges")))).orderBy(F.desc("n"))


_PARTS = values("src, dst, type", "('a', 'b', 'has_part')", "('a', 'zz', 'has_part')", "('b', 'b', 'is_a')", "('yy', 'a', 'references')")


@fixture("SELECT * FROM (VALUES ('a', 'zz'), ('yy', 'a')) t(src, dst)")
def j16_dangling_edges(spark, read):
    """Edges with an end that is no node."""
    return G.dangling(spark.sql("SELECT * FROM VALUES ('a'), ('b') AS n(id)"), spark.sql(f"SELECT * FROM {_PARTS}")).select("src", "dst")


# ---- retrieval -------------------------------------------------------------------------------

_COS = "list_dot_product(q.embedding::DOUBLE[], p.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(p.embedding::DOUBLE[], p.embedding::DOUBLE[])) + 1e-10)"
_TOP = f"SELECT * FROM (SELECT q.vec_id AS query_id, p.vec_id AS id, q.label AS ql, p.label AS pl, round({_COS}, 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 9) DESC, p.vec_id) AS rank FROM embeddings q, embeddings p WHERE q.vec_id % 100 = 0) WHERE rank <= 5"


def _top(read, k=5, threshold=None):
    e = read("embeddings")
    return R.top_k(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), k, threshold)


@query(f"SELECT query_id, id, score, rank FROM ({_TOP})")
def t1_cosine_top_k(spark, read):
    """Exact top five by cosine."""
    return _top(read).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"SELECT q.vec_id AS query_id, count(*) AS near FROM embeddings q, embeddings p WHERE q.vec_id % 100 = 0 AND round({_COS}, 9) >= 0.3 GROUP BY 1")
def p8_score_threshold(spark, read):
    """Points above a score."""
    e = read("embeddings")
    return R.above(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 0.3)


_MEASURED = f"SELECT query_id, any_value(ql) AS domain, count(*) FILTER (pl = ql) / 5.0 AS precision, count(*) FILTER (pl = ql)::DOUBLE / (SELECT count(*) FROM embeddings e WHERE e.label = any_value(ql)) AS recall FROM ({_TOP}) GROUP BY query_id"


def _measured(read):
    e = read("embeddings").select(F.col("vec_id").alias("id"), "label")
    size = e.groupBy("label").agg(F.count("*").alias("relevant"))
    labels = e.toDF("query_id", "domain")
    found = _top(read).join(e, "id").join(labels, "query_id").groupBy("query_id", "domain").agg(F.count_if(F.col("label") == F.col("domain")).alias("hits"), F.count("*").alias("n"))
    return found.join(size, F.col("label") == F.col("domain")).select("query_id", "domain", (F.col("hits") / F.col("n")).alias("precision"), (F.col("hits") / F.col("relevant")).alias("recall"))


@query(f"SELECT query_id, domain, round(precision, 6)::DOUBLE AS precision, round(recall, 6)::DOUBLE AS recall FROM ({_MEASURED})")
def a8_recall_precision(spark, read):
    """Recall and precision of each query, relevant being what shares its label."""
    return _measured(read).select("query_id", "domain", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"SELECT domain, count(*) AS queries, round(avg(precision), 3)::DOUBLE AS precision, round(avg(recall), 3)::DOUBLE AS recall, count(*) FILTER (recall = 0) AS no_recall FROM ({_MEASURED}) GROUP BY domain")
def a9_macro_averages(spark, read):
    """Averages by domain and queries without recall."""
    return _measured(read).groupBy("domain").agg(F.count("*").alias("queries"), F.round(F.avg("precision"), 3).alias("precision"), F.round(F.avg("recall"), 3).alias("recall"), F.count_if(F.col("recall") == 0).alias("no_recall"))


_LISTS = values("id, found, expected", "(1, 'a,b,b,c', 'a,b')", "(2, '', 'a')", "(3, 'x', '')", "(4, 'a,a', 'a,a,b')")


@fixture("SELECT * FROM (VALUES (1, 1.0::DOUBLE, 0.5::DOUBLE), (2, 0.0, 0.0), (3, 0.0, 0.0), (4, 0.5, 0.5)) t(id, recall, precision)")
def u4_list_measures(spark, read):
    """The measures on lists with repeats and empties."""
    lists = spark.sql(f"SELECT * FROM {_LISTS}").select("id", *[F.filter(F.split(c, ","), lambda x: x != "").alias(c) for c in ("found", "expected")])
    return lists.select("id", R.measures(F.col("found"), F.col("expected")).alias("m")).select("id", "m.recall", "m.precision")


@query("SELECT vec_id AS id, a.label AS law, count(*) OVER (PARTITION BY a.label) AS in_law FROM embeddings a")
def j7_payload(spark, read):
    """Payloads by the full key, so ids of different laws never mix."""
    e = read("embeddings")
    n = e.groupBy(F.col("label").alias("l")).agg(F.count("*").alias("in_law"))
    return e.join(n, F.col("l") == F.col("label")).select(F.col("vec_id").alias("id"), F.col("label").alias("law"), "in_law")

