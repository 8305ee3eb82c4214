"""Versioned records: inventory groups S, P, J, W, T, M and X on the star schema, laws as customers and articles as line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import dates as D
from lexloom.functions import text as T
from lexloom.operators import versions as V

from .registry import fixture, query, values

# ---- snapshots and diffs -------------------------------------------------------------------

_SNAP = """SELECT CAST(l_partkey AS VARCHAR) AS law, CAST(l_linenumber AS VARCHAR) AS no, max(concat(l_returnflag, ' ', l_linestatus, ' ', CAST(CAST(l_quantity AS INT) AS VARCHAR))) AS text
FROM lineitem WHERE l_shipdate >= TIMESTAMP '{0}-01-01' AND l_shipdate < TIMESTAMP '{1}-01-01' GROUP BY 1, 2"""
_DIFF = f"""WITH a AS ({_SNAP.format(1995, 1996)}), b AS ({_SNAP.format(1996, 1997)})
SELECT coalesce(a.law, b.law) AS law, coalesce(a.no, b.no) AS no, a.text AS old, b.text AS new,
 CASE WHEN a.text IS NULL THEN 'added' WHEN b.text IS NULL THEN 'removed' WHEN replace(a.text, ' ', '') = replace(b.text, ' ', '') THEN 'unchanged' ELSE 'modified' END AS kind
FROM a FULL OUTER JOIN b ON a.law = b.law AND a.no = b.no"""


def _snapshot(read, year: int):
    rows = read("lineitem").where((F.col("l_shipdate") >= F.lit(f"{year}-01-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit(f"{year + 1}-01-01").cast("timestamp_ntz")))
    text = F.concat_ws(" ", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").cast("string"))
    return rows.groupBy(F.col("l_partkey").cast("string").alias("law"), F.col("l_linenumber").cast("string").alias("no")).agg(F.max(text).alias("text"))


@query(_DIFF)
def x1_snapshot_diff(spark, read):
    """J4, X-1: article-level full outer diff of two snapshots, for all laws at once."""
    return V.diff_articles(_snapshot(read, 1995), _snapshot(read, 1996), ["law"]).select("law", "no", "old", "new", "kind")


@query(f"SELECT law, count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'removed') AS removed, count(*) FILTER (kind = 'modified') AS modified, count(*) FILTER (kind = 'unchanged') AS unchanged FROM ({_DIFF}) GROUP BY law HAVING count(*) FILTER (kind <> 'unchanged') > 0")
def x4_diff_all(spark, read):
    """X-3, X-4, A3: counts by kind, of laws with any change."""
    d = V.diff_articles(_snapshot(read, 1995), _snapshot(read, 1996), ["law"])
    counts = d.groupBy("law").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("added", "removed", "modified", "unchanged")])
    return counts.where("added + removed + modified > 0")


@query(f"SELECT law, no, kind, old AS old_side, new AS new_side FROM ({_DIFF}) WHERE kind = 'modified'")
def x5_diff_sides(spark, read):
    """X-2, X-5: character operations of modified articles; each side read back from them."""
    d = V.with_operations(V.diff_articles(_snapshot(read, 1995), _snapshot(read, 1996), ["law"])).where("kind = 'modified'")
    return d.select("law", "no", "kind", V.side("ops", ("=", "-")).alias("old_side"), V.side("ops", ("=", "+")).alias("new_side"))


_PAIRS = values("id, old, new", "(1, '甲乙丙', '甲丙')", "(2, 'abc', 'abxc')", "(3, 'same', 'same')", "(4, 'paq', 'pq')", "(5, '', 'new')", "(6, 'old', '')")


@fixture(f"SELECT id, CASE id WHEN 1 THEN '=甲|-乙|=丙' WHEN 2 THEN '=ab|+x|=c' WHEN 3 THEN '=same' WHEN 4 THEN '=p|-a|=q' WHEN 5 THEN '+new' ELSE '-old' END AS ops, CASE id WHEN 1 THEN '-乙' WHEN 2 THEN '+x' WHEN 3 THEN '' WHEN 4 THEN '-a' WHEN 5 THEN '+new' ELSE '-old' END AS summary FROM {_PAIRS}")
def x2_char_operations(spark, read):
    """X-2, F56: a true longest common subsequence, and the short summary of its changes."""
    from lexloom.functions.udfs import char_diff

    rows = spark.sql(f"SELECT * FROM {_PAIRS}").withColumn("o", char_diff("old", "new"))
    return rows.select("id", F.array_join(F.transform("o", lambda x: F.concat(x["t"], x["s"])), "|").alias("ops"), V.summary("o").alias("summary"))


# ---- ingest, retention, as-of --------------------------------------------------------------

_ORDERS = "SELECT o_custkey AS pcode, o_orderkey AS seq, strftime(o_orderdate, '%Y%m%d') AS version, o_orderstatus AS level FROM orders"


def _orders(read):
    return read("orders").select(F.col("o_custkey").alias("pcode"), F.col("o_orderkey").alias("seq"), F.date_format("o_orderdate", "yyyyMMdd").alias("version"), F.col("o_orderstatus").alias("level"))


@query(f"SELECT pcode, seq, version, level FROM (SELECT *, row_number() OVER (PARTITION BY pcode ORDER BY seq DESC) AS rn FROM ({_ORDERS} WHERE o_orderstatus = 'O' UNION ALL {_ORDERS} WHERE o_orderstatus <> 'O')) WHERE rn = 1")
def s3_latest_index_row(spark, read):
    """Two sources in one union; the last row of a key wins."""
    o = _orders(read)
    return V.latest(o.where("level = 'O'").unionByName(o.where("level != 'O'")), ["pcode"], F.desc("seq"))


@query(f"SELECT pcode, version FROM (SELECT *, row_number() OVER (PARTITION BY pcode ORDER BY version DESC) AS rn FROM (SELECT DISTINCT pcode, version FROM ({_ORDERS}))) WHERE rn <= 8")
def w1_retention(spark, read):
    """The eight greatest versions of each law."""
    return V.retain(_orders(read).select("pcode", "version").distinct(), "pcode", "version")


@query(f"WITH v AS (SELECT DISTINCT pcode, version FROM ({_ORDERS})), r AS (SELECT *, row_number() OVER (PARTITION BY pcode ORDER BY version DESC) AS rn FROM v) SELECT pcode, max(CASE WHEN rn = 1 THEN version END) AS latest, max(CASE WHEN rn = 2 THEN version END) AS previous, max(CASE WHEN rn = 1 THEN first END) AS first FROM (SELECT r.*, min(version) OVER (PARTITION BY pcode) AS first FROM r) GROUP BY pcode")
def w2_latest_and_previous(spark, read):
    """Newest, previous and first version of each law."""
    versions = F.array_sort(F.collect_set("version"))
    rows = _orders(read).groupBy("pcode").agg(versions.alias("v"))
    return rows.select("pcode", F.element_at("v", -1).alias("latest"), F.try_element_at("v", F.lit(-2)).alias("previous"), F.element_at("v", 1).alias("first"))


_MOMENTS = "SELECT c_custkey AS pcode, CASE WHEN c_custkey % 2 = 0 THEN '19950615' ELSE '19970101' END AS moment FROM customer"


@query(f"WITH v AS (SELECT DISTINCT pcode, version FROM ({_ORDERS})), m AS ({_MOMENTS}) SELECT m.pcode, m.moment, max(v.version) AS as_of_version FROM m LEFT JOIN v ON v.pcode = m.pcode AND v.version <= m.moment GROUP BY 1, 2")
def j5_asof_version(spark, read):
    """The version in force at a moment, inclusive; null before the first."""
    moments = read("customer").select(F.col("c_custkey").alias("pcode"), F.when(F.col("c_custkey") % 2 == 0, "19950615").otherwise("19970101").alias("moment"))
    return V.as_of(_orders(read).select("pcode", "version").distinct(), moments, "pcode", "version", "moment")


# ---- tracking ------------------------------------------------------------------------------

_TRACKED = "SELECT c_custkey AS pcode, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE '19960101' END AS baseline FROM customer WHERE c_custkey % 2 = 0"
_INDEX = "SELECT o_custkey AS pcode, max(strftime(o_orderdate, '%Y%m%d')) AS current, bool_and(o_orderstatus = 'F') AS abolished FROM orders GROUP BY 1"
_CHECK = f"""SELECT t.pcode, t.baseline, i.current, CASE WHEN i.current IS NULL THEN 'missing' WHEN i.abolished THEN 'abolished' WHEN t.baseline IS NULL THEN 'newly_tracked' WHEN i.current > t.baseline THEN 'changed' ELSE 'unchanged' END AS status
FROM ({_TRACKED}) t LEFT JOIN ({_INDEX}) i USING (pcode)"""


def _checked(read):
    c = read("customer")
    tracked = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("pcode"), F.when(F.col("c_custkey") % 5 != 0, "19960101").alias("baseline"))
    index = read("orders").groupBy(F.col("o_custkey").alias("pcode")).agg(F.max(F.date_format("o_orderdate", "yyyyMMdd")).alias("current"), F.bool_and(F.col("o_orderstatus") == "F").alias("abolished"))
    return V.check(tracked, index)


@query(_CHECK)
def m5_check_states(spark, read):
    """The state of every tracked law, in one plan."""
    return _checked(read).select("pcode", "baseline", "current", "status")


@query(f"SELECT pcode, CASE WHEN status IN ('newly_tracked', 'changed') THEN current ELSE baseline END AS baseline FROM ({_CHECK})")
def m5_next_baseline(spark, read):
    """M5: the baselines after an official check; checking again then finds no change."""
    return V.next_baseline(_checked(read))


@query(f"SELECT pcode, baseline AS old_version, current AS new_version, status FROM ({_CHECK}) WHERE status IN ('unchanged', 'changed')")
def m4_history_rows(spark, read):
    """M4: what a check appends to the history."""
    return V.history_rows(_checked(read))


@query(f"SELECT status, count(*) AS laws, count(*) FILTER (status = 'changed') AS changed FROM ({_CHECK}) GROUP BY status")
def a3_check_summary(spark, read):
    """Counts by status."""
    return _checked(read).groupBy("status").agg(F.count("*").alias("laws"), F.count_if("changed").alias("changed"))


_KEYS = values("pcode, level", "(1, 'a')", "(2, 'b')", "(3, 'c')")
_NEW = values("pcode, level", "(2, 'B')", "(9, 'Z')")


@fixture(f"SELECT 'ignore' AS mode, pcode, level FROM {_KEYS} UNION ALL SELECT 'ignore', pcode, level FROM {_NEW} WHERE pcode NOT IN (SELECT pcode FROM {_KEYS}) UNION ALL SELECT 'replace', pcode, level FROM {_KEYS} WHERE pcode NOT IN (SELECT pcode FROM {_NEW}) UNION ALL SELECT 'replace', pcode, level FROM {_NEW} UNION ALL SELECT 'delete', pcode, level FROM {_KEYS} WHERE pcode <> 2 UNION ALL SELECT 'update', pcode, CASE WHEN pcode = 2 THEN 'U' ELSE level END FROM {_KEYS}")
def m1_row_changes(spark, read):
    """M1, M2, M3: insert-or-ignore, insert-or-replace, delete and update of a keyed table."""
    base, new = spark.sql(f"SELECT * FROM {_KEYS}"), spark.sql(f"SELECT * FROM {_NEW}")
    sets = {"ignore": V.insert_ignore(base, new, ["pcode"]), "replace": V.upsert(base, new, ["pcode"]), "delete": base.where("pcode != 2"), "update": base.withColumn("level", F.when(F.col("pcode") == 2, "U").otherwise(F.col("level")))}
    out = None
    for mode, rows in sets.items():
        rows = rows.select(F.lit(mode).alias("mode"), "pcode", "level")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT e.event_id AS id, e.user_id AS pcode, c.c_name AS name, e.event_type AS status FROM events e JOIN customer c ON c.c_custkey = e.user_id WHERE e.ts >= (SELECT max(ts) - INTERVAL 7 DAY FROM events) ORDER BY e.ts DESC, id LIMIT 50")
def j1_recent_changes(spark, read):
    """The newest history rows of the last days with their law's name; the cut-off is data, not the clock."""
    e = read("events")
    last = e.agg((F.max("ts") - F.expr("INTERVAL 7 DAYS")).alias("since"))
    recent = e.join(F.broadcast(last)).where(F.col("ts") >= F.col("since"))
    named = recent.join(read("customer"), F.col("c_custkey") == F.col("user_id"))
    return named.orderBy(F.desc("ts"), "event_id").limit(50).select(F.col("event_id").alias("id"), F.col("user_id").alias("pcode"), F.col("c_name").alias("name"), F.col("event_type").alias("status"))


@query("SELECT event_id, event_type FROM events WHERE user_id = (SELECT min(user_id) FROM events) ORDER BY ts DESC, event_id LIMIT 20")
def t4_history_of_one(spark, read):
    """One law's history, newest first."""
    e = read("events")
    one = e.agg(F.min("user_id").alias("user_id"))
    return e.join(F.broadcast(one), "user_id").orderBy(F.desc("ts"), "event_id").limit(20).select("event_id", "event_type")


@query("SELECT c.c_custkey AS pcode, coalesce(n.name, c.c_name) AS name, coalesce(n.versions, 0) AS versions, left(c.c_name, 8) AS short FROM customer c LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS name, count(*) AS versions FROM orders GROUP BY 1) n ON n.o_custkey = c.c_custkey")
def j2_enriched_tracking(spark, read):
    """Left outer enrichment with defaults and cut texts."""
    n = read("orders").groupBy("o_custkey").agg(F.max("o_orderpriority").alias("name"), F.count("*").alias("versions"))
    rows = read("customer").join(n, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select(F.col("c_custkey").alias("pcode"), F.coalesce("name", "c_name").alias("name"), F.coalesce("versions", F.lit(0)).alias("versions"), F.left("c_name", F.lit(8)).alias("short"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j3_tracked_only(spark, read):
    """Semi join; only what is tracked goes on."""
    return read("orders").join(read("customer").where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def p10_excluded(spark, read):
    """Anti join against an exclusion list."""
    return read("customer").join(read("orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT count(DISTINCT user_id) FILTER (event_type = 'purchase' AND ts >= m) AS changed_recently, count(DISTINCT user_id) AS tracked FROM events, (SELECT max(ts) - INTERVAL 7 DAY AS m FROM events)")
def a1_changed_recently(spark, read):
    """A1, A2: distinct laws with a change in the last days, among all."""
    e = read("events")
    e = e.join(F.broadcast(e.agg((F.max("ts") - F.expr("INTERVAL 7 DAYS")).alias("m"))))
    hit = (F.col("event_type") == "purchase") & (F.col("ts") >= F.col("m"))
    return e.agg(F.count_distinct(F.when(hit, F.col("user_id"))).alias("changed_recently"), F.count_distinct("user_id").alias("tracked"))


@query("SELECT p_partkey, p_name, CASE WHEN p_name = 'Brand#1' THEN 0 WHEN starts_with(p_name, 'p') THEN 1 ELSE 2 END AS tier FROM part WHERE contains(p_name, 'p') ORDER BY tier, CASE WHEN p_brand = 'Brand#11' THEN 0 ELSE 1 END, p_name, p_partkey LIMIT 30")
def p2_tiered_search(spark, read):
    """Equal, then beginning, then anywhere, in one scan; capped."""
    names = read("part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("level"))
    found = V.search(names, "p", "Brand#11")
    return found.orderBy("tier", F.when(F.col("level") == "Brand#11", 0).otherwise(1), "name", "p_partkey").limit(30).select("p_partkey", F.col("name").alias("p_name"), "tier")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(c_name, '7') ORDER BY c_custkey LIMIT 10")
def p3_search_entity(spark, read):
    """Substring on a label, in order, capped."""
    return read("customer").where(F.col("c_name").contains("7")).orderBy("c_custkey").limit(10).select("c_custkey", "c_name")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'red' WHEN c_mktsegment = 'BUILDING' THEN 'yellow' WHEN c_nationkey % 2 = 0 THEN 'green' ELSE 'red' END AS color, CASE c_nationkey % 4 WHEN 0 THEN 'weekly' WHEN 1 THEN 'monthly' WHEN 2 THEN 'quarterly' ELSE 'other' END AS frequency FROM customer")
def p12_status_color(spark, read):
    """Traffic lights and interval labels."""
    k = F.col("c_nationkey") % 4
    color = F.when(F.col("c_acctbal") < 0, "red").when(F.col("c_mktsegment") == "BUILDING", "yellow").when(F.col("c_nationkey") % 2 == 0, "green").otherwise("red")
    return read("customer").select("c_custkey", color.alias("color"), F.when(k == 0, "weekly").when(k == 1, "monthly").when(k == 2, "quarterly").otherwise("other").alias("frequency"))


@query("SELECT CASE WHEN c_acctbal < 0 THEN 'red' WHEN c_mktsegment = 'BUILDING' THEN 'yellow' WHEN c_nationkey % 2 = 0 THEN 'green' ELSE 'red' END AS color, count(*) AS laws FROM customer GROUP BY 1")
def a19_traffic_lights(spark, read):
    """Laws by colour."""
    color = F.when(F.col("c_acctbal") < 0, "red").when(F.col("c_mktsegment") == "BUILDING", "yellow").when(F.col("c_nationkey") % 2 == 0, "green").otherwise("red")
    return read("customer").groupBy(color.alias("color")).agg(F.count("*").alias("laws"))


_NOS = values("no", "('2')", "('10')", "('9')", "('9-1')", "('9-A')", "('A1')", "('9-12')", "('1')")


@fixture(f"SELECT no, row_number() OVER (ORDER BY coalesce(TRY_CAST(split_part(no, '-', 1) AS INT), 2147483647), coalesce(TRY_CAST(split_part(no, '-', 2) AS INT), 0), no) AS pos FROM {_NOS}")
def t6_article_order(spark, read):
    """Natural article order; letters do not fail."""
    from pyspark.sql import Window

    return spark.sql(f"SELECT * FROM {_NOS}").withColumn("pos", F.row_number().over(Window.orderBy(*T.article_order(F.col("no")))))


_SNAPSHOT_JSON = values("pcode, j", """('A1', '{"20200101": {"1": "x", "9-1": "y"}, "20210101": {"1": "x2"}, "_oldver": {"1": "z"}}')""", """('B2', '{"20190101": {}}')""")


@fixture("""SELECT * FROM (VALUES ('A1', '20200101', '1', 'x'), ('A1', '20200101', '9-1', 'y'), ('A1', '20210101', '1', 'x2')) t(pcode, version, article_no, text)""")
def s4_snapshot_rows(spark, read):
    """Nested snapshot JSON as rows; internal versions are left out."""
    return V.snapshot_rows(spark.sql(f"SELECT * FROM {_SNAPSHOT_JSON}"), "pcode", "j")


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&nbsp;', ' ', 'g'), '[ \\t\\n]+', ' ', 'g')) AS heading, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages")
def s8_headings(spark, read):
    """Parts of landed HTML by patterns, cleaned."""
    heading = F.trim(F.regexp_replace(F.replace(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), F.lit("&nbsp;"), F.lit(" ")), r"[ \t\n]+", " "))
    return read("pages").select("page_id", heading.alias("heading"), F.size(F.regexp_extract_all("html", F.lit("<p>"), F.lit(0))).cast("long").alias("paragraphs"))


@query("SELECT o_orderkey AS pcode, l_linenumber AS version, left(l_returnflag || l_linestatus, 500) AS text FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rn FROM lineitem) JOIN orders ON o_orderkey = l_orderkey WHERE rn = 1")
def s9_first_version(spark, read):
    """The first version of each file, cut; of equal ones that which stands first in the table's files."""
    rows = read("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    first = V.latest(rows, ["l_orderkey"], F.asc("l_linenumber"), F.asc("file"), F.asc("place"))
    return first.join(read("orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("pcode"), F.col("l_linenumber").alias("version"), F.left(F.concat("l_returnflag", "l_linestatus"), F.lit(500)).alias("text"))


@query("SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'orphan orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def s23_catalog_counts(spark, read):
    """Row counts of tables and a foreign-key check."""
    out = None
    for t in ("region", "nation", "customer", "orders"):
        one = read(t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    orphans = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(F.count("*").alias("n"))
    return out.unionByName(orphans.select(F.lit("orphan orders").alias("name"), "n"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 10 <> 3 UNION ALL SELECT vec_id, label + 100 FROM embeddings WHERE vec_id % 10 = 3")
def s15_vector_upsert(spark, read):
    """Points replaced by id."""
    e = read("embeddings").select("vec_id", "label")
    return V.upsert(e, e.where("vec_id % 10 = 3").withColumn("label", (F.col("label") + 100).cast("int")), ["vec_id"])


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 20")
def w5_last_turns(spark, read):
    """The last turns of each conversation."""
    return V.retain(read("conversations").select("conv_id", "turn", "role"), "conv_id", "turn", 20)


@query("SELECT task, word FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY length(word) DESC, word) AS rn FROM (SELECT DISTINCT p_brand AS task, p_type AS word FROM part)) WHERE rn <= 3")
def w6_longest_words(spark, read):
    """Up to three samples of each group, the longest first."""
    rows = read("part").select(F.col("p_brand").alias("task"), F.col("p_type").alias("word")).distinct()
    from pyspark.sql import Window

    w = Window.partitionBy("task").orderBy(F.desc(F.length("word")), "word")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn <= 3").drop("rn")


@query("SELECT user_id, event_id, h AS hash, coalesce(lag(h) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') AS prev_hash FROM (SELECT *, sha256(CAST(event_id AS VARCHAR) || event_type) AS h FROM events)")
def w7_hash_chain(spark, read):
    """Each row with the hash of the one before it."""
    return V.hash_chain(read("events"), "user_id", ["ts", "event_id"], F.concat(F.col("event_id").cast("string"), "event_type")).select("user_id", "event_id", "hash", "prev_hash")


_DATES = values("s", "('中華民國一百零六年六月十四日')", "('中華民國 106 年 6 月 14 日')", "('民國二十年十二月一日')", "('無日期')", "('')")


@fixture(f"SELECT s, CASE WHEN s LIKE '%一百零六%' OR s LIKE '%106%' THEN '20170614' WHEN s LIKE '%二十年%' THEN '19311201' ELSE '' END AS ymd FROM {_DATES}")
def f2_roc_dates(spark, read):
    """dates of the Republic's calendar, with either kind of numeral."""
    return spark.sql(f"SELECT * FROM {_DATES}").select("s", D.roc_date(F.col("s")).alias("ymd"))


_NUMBERS = values("s, n", "('十', 10)", "('一百零六', 106)", "('二〇', 0)", "('三千二百', 3200)", "('兩百', 200)", "('九十九', 99)", "('', 0)", "('第五條', 5)", "('二十', 20)", "('一千零一', 1001)")


@fixture(f"SELECT s, n AS value FROM {_NUMBERS}")
def f1_chinese_numbers(spark, read):
    """Chinese numerals as a fold over characters."""
    return spark.sql(f"SELECT s FROM {_NUMBERS}").select("s", D.chinese_number(F.col("s")).alias("value"))


@fixture("SELECT * FROM (VALUES ('20111231,20170614'), ('')) t(dates)")
def f3_amendment_dates(spark, read):
    """All dates of a history, distinct and ascending."""
    rows = spark.sql("SELECT * FROM VALUES ('1. 中華民國一百零六年六月十四日公布 2. 中華民國一百年十二月三十一日修正 3. 中華民國一百零六年六月十四日'), ('無') AS t(h)")
    return rows.select(F.array_join(D.amendment_dates(F.col("h")), ",").alias("dates"))


_YMD = values("s", "('2023-02-30')", "('2023/02/28')", "('20240229')", "('2024')", "('')", "('民國')")


@fixture(f"SELECT s, CASE WHEN length(d) = 8 AND TRY_STRPTIME(d, '%Y%m%d') IS NOT NULL THEN d ELSE '' END AS ymd, CASE WHEN length(d) = 8 AND TRY_STRPTIME(d, '%Y%m%d') IS NOT NULL THEN strftime(TRY_STRPTIME(d, '%Y%m%d') + INTERVAL 7 DAY, '%Y%m%d') ELSE '' END AS later, CASE WHEN length(s) = 8 THEN substr(s, 1, 4) || '-' || substr(s, 5, 2) || '-' || substr(s, 7, 2) ELSE s END AS shown FROM (SELECT s, regexp_replace(s, '[^0-9]', '', 'g') AS d FROM {_YMD})")
def f4_dates(spark, read):
    """real dates only, day arithmetic, display."""
    s = F.col("s")
    return spark.sql(f"SELECT * FROM {_YMD}").select("s", D.ymd(s).alias("ymd"), D.add_days(s, 7).alias("later"), D.dashed(s).alias("shown"))
