"""The rule, citation, committee and document families over whole tables.

Their texts and lists are put together from the tables' columns by expressions that
Spark and the oracle both read; what comes out is computed on either side.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexloom import lexicon
from lexloom.functions import citation as C
from lexloom.functions import dates as D
from lexloom.functions import text as T
from lexloom.functions import vectors
from lexloom.operators import consensus as K
from lexloom.operators import graph as G
from lexloom.operators import retrieval as N
from lexloom.operators import rules as R
from lexloom.operators import similarity
from lexloom.operators import versions as V
from lexloom.sources import seed, tables
from lexloom.sources.shared import checkpoint

from .committee import _COS, _EDGES, _NODES, _graph
from .registry import fixture, query
from .texts import _ADVISED, _ROUTE, _STATUS, _SURE, _VIOLATIONS


class Source:
    """Columns of a table by expressions of both dialects."""

    def __init__(self, table: str, *columns: str):
        self.table, self.columns = table, columns

    def __call__(self, read):
        return read(self.table).selectExpr(*self.columns)

    def __str__(self):
        return f"(SELECT {', '.join(self.columns)} FROM {self.table})"


def pick(key: str, *expressions: str) -> str:
    return f"CASE ({key}) % {len(expressions)} " + " ".join(f"WHEN {k} THEN {e}" for k, e in enumerate(expressions)) + " END"


def quoted(*texts: str) -> list[str]:
    return ["'" + t.replace("'", "''") + "'" for t in texts]


def _list(*items: str) -> str:
    """The items that are not null, joined by commas, in the oracle's dialect."""
    return f"array_to_string(list_filter([{', '.join(items)}], lambda x: x IS NOT NULL), ',')"


_DAY = "year({0}) * 10000 + month({0}) * 100 + day({0})"

# ---- what answers say: statuses, routes, advice, violations -------------------------------------

_SAID = Source(
    "events", "event_id AS id", "user_id % 5 AS query_id", "'m' || (event_id % 3) AS model",
    pick("event_id", "'§987 已刪除'", "'查無此條號 §' || user_id", "'該條文已於2007年刪除'", "'第' || user_id || '條 規定之內容'", "''", "'API 呼叫失敗：429 Too Many Requests'", "'抱歉，我無法回答這個問題'",
         "'本條已修正，現行條文修正後第' || user_id || '條與第' || (user_id + 1) || '條'", "'I CANNOT VERIFY this'", "'第' || user_id || '條已廢止，第' || user_id || '條'", "event_type") + " AS text",
)


@query(f"SELECT id, {_STATUS} AS status, round(CAST({_SURE} AS DOUBLE), 6) AS confidence FROM {_SAID}")
def f14_status_rows(spark, read):
    """what each answer says about an article, and how surely."""
    s = C.status(F.col("text"))
    return _SAID(read).select("id", s["status"].alias("status"), F.round(s["confidence"].cast("double"), 6).alias("confidence"))


@query(f"SELECT id, CASE WHEN coalesce({_STATUS}, '') = 'error' THEN 'error' ELSE 'agree' END AS state, coalesce({_STATUS}, 'unknown') AS claim_status FROM {_SAID}")
def f54_response_layers(spark, read):
    """the state of a response, and its wording by layer: citations in one form, statuses in one word."""
    layers = K.response_layers(F.col("text"))
    return _SAID(read).select("id", layers.alias("x")).select("id", "x.state", "x.claim_status")


_REFS = "regexp_extract_all(text, '第([0-9]+(?:之[0-9]+)?)條', 1)"
_CLAIMS = f"SELECT query_id, model, id, unnest(range(len({_REFS}))) AS pos, '民法第' || unnest({_REFS}) || '條' AS article_ref, {_STATUS} AS status FROM {_SAID} UNION ALL SELECT query_id, model, id, 0, 'general', NULL FROM {_SAID} WHERE len({_REFS}) = 0"


@query(f"SELECT query_id, model, CAST(pos AS INT) AS pos, article_ref, status, count(*) AS n FROM ({_CLAIMS}) GROUP BY ALL")
def f18_claim_rows(spark, read):
    """answers as claims, one for each article cited, or one without."""
    return K.claims(_SAID(read)).groupBy("query_id", "model", "pos", "article_ref", "status").agg(F.count("*").alias("n"))


@query(f"SELECT query_id, article_ref, string_agg(DISTINCT model, ',' ORDER BY model) AS models, CASE WHEN count(DISTINCT status) <= 1 THEN 'consensus' ELSE 'disagreement' END AS label FROM ({_CLAIMS}) GROUP BY 1, 2")
def l5_cluster_rows(spark, read):
    """Claims of all queries in clusters."""
    return K.clusters(K.claims(_SAID(read)), ["query_id", "article_ref"]).select("query_id", "article_ref", "models", "label")


_ASKED = Source("events", "event_id AS id", pick("event_id", *quoted("我不想活了，對方知道我住哪", "幫我檢查這份合約的違約條款是否完整", "幫我寫一份訴狀", "對方完全抹殺我的貢獻", "模擬原告的攻防策略", "假設我不想活了", "殺", "如果他威脅我", "他威脅我", "什麼是善意第三人", "請幫我批改並評分", "比較方案A", "寫成摘要", "我要提告"), "event_type", "'查 ' || event_id || ' 號'") + " AS text")
_NAMES = "CASE task " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lexicon.TASK_NAMES.items()) + " ELSE task END"


@query(f"SELECT id, task, {_NAMES} AS name FROM (SELECT id, {_ROUTE} AS task FROM {_ASKED})")
def f19_route_rows(spark, read):
    """the task of each question, and what it is called."""
    return _ASKED(read).select("id", R.route(F.col("text")).alias("task")).withColumn("name", R.task_name(F.col("task")))


_ADVICE = Source("events", "event_id AS id", pick("event_id", *quoted("這份合約看起來還可以", "原告主張違約，被告抗辯不可抗力", "測試內容", "", "第一條條款缺失", "依據判決", "無關")) + " AS text", pick("user_id", *quoted("QC", "LITIGATION", "UNKNOWN", "RESEARCH", "SAFETY", "REPORT", "SIMULATION", "CONSULTANT")) + " AS task")


@query(f"SELECT id, CASE {_ADVISED} ELSE false END AS advised FROM {_ADVICE}")
def f22_advised_rows(spark, read):
    """answers that lack their task's patterns get advice."""
    return _ADVICE(read).select("id", (R.validate_answer(F.col("text"), F.col("task")) != F.col("text")).alias("advised"))


_WRITTEN = Source(
    "events", "event_id AS id",
    pick("event_id", *quoted("依具民法第1條，因此權利受損", "依具民法第1條 [1]，因此權利受損", "刑事案件，請見免責聲明", "刑事案件", "請 install_plugin x", "建議選擇甲", "建議選擇甲，因為便宜", "無", ""), "'電話 09' || (10000000 + event_id) || ' 信箱 a' || user_id || '@c.tw'", "event_type || ' [T1] 判決'") + " AS text",
)


@query(_VIOLATIONS.replace("ROWS", str(_WRITTEN)))
def f34_violation_rows(spark, read):
    """Broken invariants, one row each."""
    return R.violations(_WRITTEN(read)).select("id", "invariant", "severity")


@query(f"SELECT id, array_to_string(list_transform(regexp_extract_all(text, '{lexicon.PERSONAL}'), lambda m: left(m, 3) || '***'), ',') AS found FROM {_WRITTEN} WHERE regexp_matches(text, '{lexicon.PERSONAL}')")
def f40_personal_rows(spark, read):
    """Personal data, shown by its first characters."""
    return R.violations(_WRITTEN(read)).where("invariant = 'I005'").select("id", F.col("detail").alias("found"))


# ---- citations, case numbers, identifiers, dates ------------------------------------------------

_CITING = Source("lineitem", "l_orderkey", "l_linenumber", pick("l_orderkey + l_linenumber", "'§' || l_partkey", "'釋字' || l_suppkey || '號'", "'第' || l_partkey || '條'", "'民法第' || l_partkey || '條'", "l_suppkey || '台上' || l_partkey || '號'", "'見§' || l_partkey || '及第' || l_suppkey || '條之規定'", "l_returnflag") + " AS text")
_CITED = Source("lineitem", "l_orderkey", "l_linenumber", pick("l_orderkey + l_linenumber", "'民法第' || l_partkey || '條'", "'釋字第' || l_suppkey || '號'", "'民法第' || l_partkey || '條'", "'民法第' || l_partkey || '條'", "l_suppkey || '年度台上字第' || l_partkey || '號'", "'見民法第' || l_partkey || '條及民法第' || l_suppkey || '條之規定'", "l_returnflag") + " AS citation")


@query(str(_CITED)[1:-1])
def f13_citation_rows(spark, read):
    """one form for citations."""
    return _CITING(read).select("l_orderkey", "l_linenumber", C.normalize(F.col("text")).alias("citation"))


_TITLED = Source("lineitem", "l_orderkey", "l_linenumber", "l_partkey || '-' || l_linenumber AS a", "CASE WHEN l_suppkey % 3 = 0 THEN l_partkey || '-' || l_linenumber ELSE '' || l_suppkey END AS b")


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN a = b THEN a ELSE least(a, b) || ',' || greatest(a, b) END AS articles FROM {_TITLED}")
def f33_title_articles(spark, read):
    """the set of article numbers behind section signs of a title."""
    title = F.concat(F.lit("§"), "a", F.lit(" 與 §"), "b", F.lit(" 及第9條"))
    return _TITLED(read).select("l_orderkey", "l_linenumber", F.array_join(F.array_sort(T.section_numbers(title)), ",").alias("articles"))


_CASED = Source("orders", "o_orderkey", pick("o_custkey", *quoted("彰化地方法院", "臺灣高等法院高雄分院", "士林地方法院", "最高法院")) + " AS court", pick("o_custkey", *quoted("CHD", "KSH", "SLD", "TPS")) + " AS court_code", "'' || (80 + o_orderkey % 30) AS year", pick("o_orderkey", *quoted("訴", "上易", "家親聲")) + " AS case_type", "'' || o_orderkey AS case_no")


@query(f"SELECT o_orderkey, court, year, case_type, case_no, court_code FROM {_CASED}")
def f23_case_rows(spark, read):
    """Case numbers; the court with the longest name counts."""
    s = F.concat("court", F.lit(" "), "year", F.lit(" 年度 "), "case_type", F.lit("字第 "), "case_no", F.lit(" 號"))
    return _CASED(read).select("o_orderkey", C.case_number(s).alias("c")).select("o_orderkey", "c.*")


@query(f"SELECT o_orderkey, court_code || ',' || year || ',V,' || case_no || ',20230101,1' AS jid, left(sha256(court || case_no || year), 16) AS doc, case_no || '_body_' || lpad('' || (o_orderkey % 100), 2, '0') AS chunk FROM {_CASED}")
def f24_identifier_rows(spark, read):
    """case ids, document ids, chunk ids."""
    lit = F.lit
    jid = C.case_id(F.col("court"), F.col("year"), lit("民事"), F.col("case_no"), lit("20230101"), lit("1"))
    return _CASED(read).select("o_orderkey", jid.alias("jid"), T.doc_id(F.col("court"), F.col("case_no"), F.col("year")).alias("doc"), T.chunk_id(F.col("case_no"), lit("body"), F.col("o_orderkey") % 100).alias("chunk"))


_UNITS = ((1000, "千"), (100, "百"), (10, "十"))


def _numeral(n: str) -> str:
    digit = lambda by: f"CAST(floor(({n}) / {by}) AS INT) % 10"
    parts = [f"CASE WHEN {digit(by)} > 0 THEN substr('一二三四五六七八九', {digit(by)}, 1) || '{unit}' ELSE '' END" for by, unit in _UNITS]
    return " || ".join([*parts, f"CASE WHEN ({n}) % 10 > 0 THEN substr('一二三四五六七八九', CAST(({n}) % 10 AS INT), 1) ELSE '' END"])


_COUNTED = Source("orders", "o_orderkey", "CAST(1 + o_orderkey % 9999 AS INT) AS value", f"{_numeral('1 + o_orderkey % 9999')} AS s")


@query(f"SELECT o_orderkey, value FROM {_COUNTED}")
def f1_numeral_rows(spark, read):
    """Chinese numerals as a fold over characters."""
    return _COUNTED(read).select("o_orderkey", D.chinese_number(F.col("s")).alias("value"))


def _roc(date: str, chinese: bool) -> str:
    parts = [f"year({date}) - 1911", f"month({date})", f"day({date})"]
    shown = [_numeral(p) if chinese else f"({p})" for p in parts]
    return "'中華民國' || " + " || ".join(f"{p} || '{u}'" for p, u in zip(shown, ("年", "月", "日"), strict=True))


_ROC = Source("orders", "o_orderkey", f"CASE WHEN o_orderkey % 2 = 0 THEN {_roc('o_orderdate', True)} WHEN o_orderkey % 7 = 0 THEN '無日期' ELSE {_roc('o_orderdate', False)} END AS s", f"CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 7 = 0 THEN '' ELSE '' || ({_DAY.format('o_orderdate')}) END AS ymd")


@query(f"SELECT o_orderkey, ymd FROM {_ROC}")
def f2_roc_date_rows(spark, read):
    """dates of the Republic's calendar, with either kind of numeral."""
    return _ROC(read).select("o_orderkey", D.roc_date(F.col("s")).alias("ymd"))


_LATER = "o_orderdate + INTERVAL 31 DAY"
_AMENDED = Source("orders", "o_orderkey", f"'1. ' || {_roc(_LATER, False)} || '公布 2. ' || {_roc('o_orderdate', True)} || '修正 3. ' || {_roc(_LATER, True)} AS h", f"({_DAY.format('o_orderdate')}) || ',' || ({_DAY.format(_LATER)}) AS dates")


@query(f"SELECT o_orderkey, dates FROM {_AMENDED}")
def f3_amendment_rows(spark, read):
    """All dates of a history, distinct and ascending."""
    return _AMENDED(read).select("o_orderkey", F.array_join(D.amendment_dates(F.col("h")), ",").alias("dates"))


_DATED = Source("orders", "o_orderkey", f"'' || ({_DAY.format('o_orderdate')}) AS d", f"'' || ({_DAY.format('(o_orderdate + INTERVAL 7 DAY)')}) AS later", "o_orderkey % 4 AS k")


@query(f"SELECT o_orderkey, CASE WHEN k < 2 THEN d ELSE '' END AS ymd, CASE WHEN k < 2 THEN later ELSE '' END AS later, CASE k WHEN 1 THEN left(d, 4) || '-' || substr(d, 5, 2) || '-' || substr(d, 7) WHEN 0 THEN left(d, 4) || '/' || substr(d, 5, 2) || '/' || substr(d, 7) WHEN 2 THEN left(d, 4) || '/13/01' ELSE left(d, 4) END AS shown FROM {_DATED}")
def f4_date_rows(spark, read):
    """real dates only, day arithmetic, display."""
    y, m, d = (F.substring("d", *p) for p in ((1, 4), (5, 2), (7, 2)))
    s = F.when(F.col("k") == 1, F.col("d")).when(F.col("k") == 0, F.concat_ws("/", y, m, d)).when(F.col("k") == 2, F.concat(y, F.lit("/13/01"))).otherwise(y)
    return _DATED(read).select("o_orderkey", D.ymd(s).alias("ymd"), D.add_days(s, 7).alias("later"), D.dashed(s).alias("shown"))


_HISTORY = Source("orders", "o_orderkey", "o_custkey", "o_orderstatus", "CASE WHEN o_orderkey % 11 = 0 THEN '無沿革' WHEN o_orderkey % 5 = 0 THEN '1.總統華總一義令修正公布全文 ' || o_custkey || ' 條' ELSE '1. 中華民國八十年公布第 3 條\n  2.華總一義字第 ' || o_orderkey || ' 號令修正公布第 ' || o_custkey || ' 條、第 7~9 條、第 ' || o_custkey || ' 條' END AS h")


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN '總統華總一義令' ELSE '2.華總一義字第 ' || o_orderkey || ' 號' END AS doc_no, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 5 = 0 THEN '' ELSE o_custkey || '|7~9' END AS articles, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE length(h) - CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE length('1. 中華民國八十年公布第 3 條') + 5 END END AS chars FROM {_HISTORY}".replace("'2.華總", "'華總"))
def f12_amendment_summary(spark, read):
    """number, articles and text of the last entry of a history; nothing where no entry is numbered."""
    return _HISTORY(read).select("o_orderkey", V.last_amendment(F.col("h")).alias("x")).select("o_orderkey", "x.doc_no", F.array_join("x.articles", "|").alias("articles"), F.length("x.full").cast("long").alias("chars"))


# ---- documents: front matter, composition, rules ------------------------------------------------

_FRONTED = Source("orders", "o_orderkey", "o_custkey", pick("o_orderkey", "'---\nStatus: \"' || o_orderstatus || '\"\ntitle: T' || o_custkey || '\nother: x\n---\nBody ' || o_orderkey", "'no front ' || o_orderkey", "'---\nbroken ' || o_orderkey") + " AS raw", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS status", "CASE WHEN o_orderkey % 3 = 0 THEN 'T' || o_custkey END AS title", pick("o_orderkey", "'Body ' || o_orderkey", "'no front ' || o_orderkey", "'---\nbroken ' || o_orderkey") + " AS body")


@query(f"SELECT o_orderkey, body, status, title FROM {_FRONTED}")
def f28_front_matter_rows(spark, read):
    """Documents with a front matter block."""
    return _FRONTED(read).select("o_orderkey", T.front_matter(F.col("raw")).alias("m")).select("o_orderkey", "m.body", "m.status", "m.title")


_PROMPT = f"SELECT o_custkey, string_agg(CASE WHEN status IS NULL THEN '' ELSE 'status: ' || status END || chr(10) || body, chr(10) || '===' || chr(10) ORDER BY o_orderkey) AS p FROM {_FRONTED} GROUP BY 1"


@query(f"SELECT o_custkey, prompt, CAST(trunc(0.25 * length(prompt)) AS BIGINT) AS tokens FROM (SELECT o_custkey, CASE WHEN length(p) > 120 THEN left(p, 120) || '…' ELSE p END AS prompt FROM ({_PROMPT}))")
def f30_composed_rows(spark, read):
    """each customer's documents in order under their headers, joined and cut with a mark."""
    m = T.front_matter(F.col("raw"))
    part = F.concat(T.temporal_header({"status": m["status"]}), F.lit("\n"), m["body"])
    whole = T.composed(_FRONTED(read).select("o_custkey", "o_orderkey", part.alias("part")), "o_custkey", "o_orderkey", "part", "\n===\n", 120)
    return whole.select("o_custkey", F.col("text").alias("prompt"), T.tokens(F.col("text")).alias("tokens"))


_META = Source(
    "orders", "o_orderkey", "'1' AS tlds_version", pick("o_orderkey", "'ZY-LOAN-20260706-' || lpad('' || (o_orderkey % 10000), 4, '0')", "'ZY-LOAN-2026070-0001'") + " AS doc_id", "CASE WHEN o_custkey % 5 > 0 THEN 'c' END AS doc_type", "'t' AS title", "'1' AS version",
    pick("o_custkey", *quoted("draft", "final", "published")) + " AS status", "'TW' AS jurisdiction", "'zh' AS language", "true AS confidential", "'a' AS author", "CASE WHEN o_orderkey % 3 = 0 THEN 'r' END AS reviewer",
)


@query("SELECT o_orderkey, " + _list("CASE WHEN doc_type IS NULL THEN 'missing doc_type' END", "CASE WHEN status = 'published' THEN 'status' END", "CASE WHEN status = 'final' AND reviewer IS NULL THEN 'final without reviewer' END", "CASE WHEN o_orderkey % 2 = 1 THEN 'doc_id format' END") + f" AS problems FROM {_META}")
def f57_metadata_rows(spark, read):
    """Problems of document metadata."""
    return R.meta_problems(_META(read)).select("o_orderkey", F.array_join("problems", ",").alias("problems"))


_RULED = Source("orders", "o_orderkey", pick("o_orderkey", "'CL-MORT-006-v' || o_orderkey", "'CL-LOAN-001-v'", "'CL-LOAN-001'", "'x'") + " AS clause", pick("o_orderkey", "'{{PartyA.Name}} {{V' || o_orderkey || '}}'", "'{{Loan.Amount}} {{Amount}}'", "'HV-07'") + " AS text", "CASE WHEN o_orderkey % 9 = 0 THEN 'abc' ELSE '' || (o_orderkey % 20) END AS rate", "(100 + o_orderkey % 15) || '/01/31' AS early", "(100 + o_custkey % 15) || '/' || (1 + o_custkey % 12) || '/30' AS late")


@query(f"SELECT o_orderkey, o_orderkey % 4 IN (0, 2) AS clause_ok, CASE o_orderkey % 3 WHEN 0 THEN '{{{{V' || o_orderkey || '}}}}' WHEN 1 THEN '{{{{Loan.Amount}}}}' ELSE '' END AS unknown, o_orderkey % 9 > 0 AND o_orderkey % 20 <= 16 AS rate_ok, o_orderkey % 3 = 2 AS meta_text FROM {_RULED}")
def f57_rule_rows(spark, read):
    """clause ids, variables, rates, meta text."""
    c = F.col
    return _RULED(read).select("o_orderkey", c("clause").rlike(lexicon.CLAUSE_ID).alias("clause_ok"), F.array_join(R.unknown_variables(c("text")), ",").alias("unknown"), R.rate_ok(c("rate")).alias("rate_ok"), c("text").rlike(lexicon.META_TEXT).alias("meta_text"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 12 = 1 THEN false ELSE make_date(2011 + CAST(o_custkey % 15 AS INT), 1 + CAST(o_custkey % 12 AS INT), 28) + 2 > make_date(2011 + CAST(o_orderkey % 15 AS INT), 1, 31) END AS dates_ok FROM orders")
def f7_date_order_rows(spark, read):
    """dates of the Republic's calendar in order; false where one is no date."""
    return _RULED(read).select("o_orderkey", F.coalesce(D.roc_slashes(F.col("late")) > D.roc_slashes(F.col("early")), F.lit(False)).alias("dates_ok"))


_EVAL = Source(
    "customer", "c_custkey", pick("c_custkey", "'Q' || lpad('' || (c_custkey % 1000), 3, '0')", "'X1'") + " AS id", pick("c_custkey", "'2026-01-01'", "'2026'", "NULL") + " AS version", pick("c_custkey", *quoted("QC", "NO", "SAFETY")) + " AS route", pick("c_nationkey", *quoted("STANDARD", "HARD", "EDGE_CASE")) + " AS difficulty",
    pick("c_nationkey", *quoted("RL0", "N/A", "RL9", "RL3")) + " AS safety_level", pick("c_custkey", *quoted("NONE", "MAYBE")) + " AS trigger", pick("c_nationkey", *quoted("HIGH", "SOME")) + " AS confidence", pick("c_custkey", *quoted("RQ1", "RQ3", "RQ1,RQ3", "RQ2")) + " AS rq",
)


@query("SELECT c_custkey, " + _list("CASE WHEN version IS NULL THEN 'missing version' END", "CASE WHEN id = 'X1' THEN 'id format' END", "CASE WHEN version = '2026' THEN 'version format' END", "CASE WHEN route = 'NO' THEN 'route' END", "CASE WHEN difficulty = 'HARD' THEN 'difficulty' END", "CASE WHEN safety_level = 'RL9' THEN 'safety_level' END", "CASE WHEN trigger = 'MAYBE' THEN 'expected_gate_trigger' END", "CASE WHEN confidence = 'SOME' THEN 'expected_confidence' END", "CASE WHEN route = 'SAFETY' AND safety_level = 'N/A' THEN 'safety route without level' END", "CASE WHEN difficulty = 'EDGE_CASE' AND NOT contains(rq, 'RQ3') THEN 'warning: edge case without RQ3' END") + f" AS problems FROM {_EVAL}")
def f58_query_rows(spark, read):
    """Problems of evaluation queries."""
    return _EVAL(read).withColumn("rq", F.split("rq", ",")).select("c_custkey", F.array_join(R.query_problems(), ",").alias("problems"))


@query("SELECT l_orderkey, array_to_string(list_filter([" + ", ".join(quoted(*lexicon.LOAN_CLAUSES)) + "], lambda x: NOT list_contains(list(DISTINCT 'CL-LOAN-00' || (1 + l_partkey % 7)), x)), ',') AS missing FROM lineitem GROUP BY l_orderkey")
def j15_missing_rows(spark, read):
    """Required clauses that each document lacks."""
    has = F.collect_set(F.format_string("CL-LOAN-%03d", 1 + F.col("l_partkey") % 7))
    return read("lineitem").groupBy("l_orderkey").agg(has.alias("has")).select("l_orderkey", F.array_join(R.missing(F.col("has"), lexicon.LOAN_CLAUSES), ",").alias("missing"))


_GROUPED = "SELECT l_partkey, count(DISTINCT l_orderkey % 12) AS refs, l_partkey % 3 = 0 AS cited, l_partkey % 2 = 0 AS sure FROM lineitem GROUP BY l_partkey"


@query(f"SELECT l_partkey, refs, cited, sure, CAST(refs > 8 AS INT) + CAST(NOT cited AS INT) + CAST(NOT sure AS INT) AS issues, CAST(refs > 8 AS INT) + CAST(NOT cited AS INT) + CAST(NOT sure AS INT) AS issues2 FROM ({_GROUPED})")
def f31_fabrication_rows(spark, read):
    """Marks of invented citations by both rule sets, on an answer for each part."""
    rows = read("lineitem").groupBy("l_partkey").agg(F.array_join(F.collect_list(F.concat(F.lit("第"), (F.col("l_orderkey") % 12).cast("string"), F.lit("條"))), " ").alias("t"))
    text = F.concat("t", F.when(F.col("l_partkey") % 3 == 0, " [T1]").otherwise(""), F.when(F.col("l_partkey") % 2 == 0, " ✅ 信心：高").otherwise(" 信心"))
    rows = rows.select("l_partkey", R.fabrication(text).alias("a"), R.fabrication(text, first=False).alias("b"))
    return rows.select("l_partkey", F.col("a.article_refs").cast("long").alias("refs"), F.col("a.has_citation").alias("cited"), F.col("a.has_confidence").alias("sure"), F.col("a.issue_count").alias("issues"), F.col("b.issue_count").alias("issues2"))


_JSON = Source("events", "event_id", pick("event_id", "'text ```json\n[{\"issue\": \"a\"}]\n``` and ```json\n[{\"issue\": \"b' || event_id || '\"}, {\"issue\": \"\"}]\n```'", "'[{\"issue\": \"c' || event_id || '\", \"location\": \"p1\"}]'", "'{\"issues\": [{\"issue\": \"d\"}, {\"issue\": \"e' || event_id || '\"}]}'", "'noise [{\"issue\": \"f\"}] noise'", "'garbage'") + " AS raw")


@query("SELECT event_id, location, issue FROM (SELECT event_id, 'item_0' AS location, 'b' || event_id AS issue FROM events WHERE event_id % 5 = 0 UNION ALL SELECT event_id, 'p1', 'c' || event_id FROM events WHERE event_id % 5 = 1 UNION ALL SELECT event_id, 'item_0', 'd' FROM events WHERE event_id % 5 = 2 UNION ALL SELECT event_id, 'item_1', 'e' || event_id FROM events WHERE event_id % 5 = 2 UNION ALL SELECT event_id, 'item_0', 'f' FROM events WHERE event_id % 5 = 3)")
def f47_issue_rows(spark, read):
    """Issues out of fenced, bare, wrapped or embedded JSON; blank issues are dropped."""
    return R.issues(_JSON(read), "raw").select("event_id", "location", "issue")


# ---- reviewers: similarity, components, verdicts, measures --------------------------------------

_PREFIX = Source("part", "p_partkey", "p_name AS a", "left(p_name, CAST(1 + p_partkey % 9 AS INT)) AS b", "'民法第' || p_size || '條' AS c", "'第' || (p_size + p_partkey % 2) || '條' AS d")


@query(f"SELECT p_partkey, p_partkey % 2 = 0 AS equivalent, round(2.0 * length(b) / (length(a) + length(b)), 6)::DOUBLE AS ratio FROM {_PREFIX}")
def f16_similarity_rows(spark, read):
    """Equal once normalised, or an alignment ratio."""
    from lexloom.functions.udfs import similarity

    return _PREFIX(read).select("p_partkey", (C.normalize(F.col("c")) == C.normalize(F.col("d"))).alias("equivalent"), F.round(similarity("a", "b"), 6).alias("ratio"))


_ISSUES = Source("orders", "o_orderkey AS id", "o_custkey AS dimension", "'r' || (o_orderkey % 3) AS reviewer", pick("o_orderkey", *quoted("minor", "major", "critical")) + " AS severity", "(o_orderkey * 37 % 10007) || '-' || o_orderstatus || (o_custkey % 100) AS issue")
_CHARS = f"SELECT id, dimension, list_distinct(string_split(left(issue, 40), '')) AS s FROM {_ISSUES}"
_ALIKE = f"SELECT a.id AS a, b.id AS b FROM ({_CHARS}) a JOIN ({_CHARS}) b ON a.dimension = b.dimension AND a.id < b.id WHERE len(list_intersect(a.s, b.s)) > 0.75 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))"


@query(_ALIKE)
def j11_claim_rows(spark, read):
    """Claims of one dimension whose beginnings share their characters."""
    return K.similar_claims(_ISSUES(read), 0.75)


_ALIKE_LOW = f"SELECT a.id AS a, b.id AS b FROM ({_CHARS}) a JOIN ({_CHARS}) b ON a.dimension = b.dimension AND a.id < b.id WHERE len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) > 0.35"


@query(f"""WITH RECURSIVE e AS ({_ALIKE_LOW}), both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT id, id AS o FROM {_ISSUES} UNION SELECT r.id, both_.b FROM r JOIN both_ ON both_.a = r.o), c AS (SELECT id, min(o) AS component FROM r GROUP BY id)
SELECT component, n_claims, reviewers, label, severity, CASE label WHEN 'consensus' THEN 'auto_fix' ELSE 'verify_apply' END AS action FROM (SELECT component, count(*) AS n_claims, count(DISTINCT reviewer) AS reviewers, CASE WHEN count(DISTINCT reviewer) >= 2 THEN 'consensus' ELSE 'unique_insight' END AS label, CASE WHEN bool_or(severity = 'critical') THEN 'critical' WHEN bool_or(severity = 'major') THEN 'major' ELSE 'minor' END AS severity FROM c JOIN {_ISSUES} USING (id) GROUP BY component)""")
def r4_component_rows(spark, read):
    """Similar claims to components, their label, gravest severity and action."""
    rows = _ISSUES(read)
    comp = similarity.of_claims(rows).drop("links")
    worst = F.max_by("severity", K.severity_rank(F.col("severity")))
    out = rows.join(comp, "id").groupBy("component").agg(F.count("*").alias("n_claims"), F.count_distinct("reviewer").alias("reviewers"), worst.alias("severity"))
    out = out.withColumn("label", F.when(F.col("reviewers") >= 2, "consensus").otherwise("unique_insight"))
    return out.select("component", "n_claims", "reviewers", "label", "severity", K.action(F.col("label"))["action"].alias("action"))


#: Values of a stated set that is sent along with every row.
FEW = 10_000


def _few(rows, *columns):
    """One row with the distinct values of a stated set, counted before they are brought together."""
    kept = checkpoint(rows.select(F.struct(*columns).alias("d") if len(columns) > 1 else F.col(columns[0]).alias("d")).distinct())
    if (n := kept.count()) > FEW:
        raise ValueError(f"{n} values are no stated set of a few")
    return kept.agg(F.collect_list("d").alias("d"))


@query("SELECT b.p_brand AS brand, t.p_type AS dimension FROM (SELECT DISTINCT p_brand FROM part) b, (SELECT DISTINCT p_type FROM part) t EXCEPT SELECT p_brand, p_type FROM part WHERE p_size > 25")
def r5_uncovered_rows(spark, read):
    """Expected dimensions that no claim covers, for each brand; the expected ones are a stated few."""
    part = read("part")
    expected = part.select(F.col("p_brand").alias("brand")).distinct().join(F.broadcast(_few(part, "p_type"))).select("brand", F.explode("d").alias("dimension"))
    return expected.join(part.where("p_size > 25").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("dimension")), ["brand", "dimension"], "left_anti")


_ANSWERED = Source("orders", "o_custkey AS q", "o_orderpriority AS provider", "o_orderkey AS priority", "o_orderstatus <> 'P' AS ok", "repeat(chr(CAST(97 + o_orderkey % 26 AS INT)), 3) || repeat(lpad('' || o_custkey, 6, '0'), CAST(5 + 5 * (o_custkey % 2) AS INT)) AS text")


@query(f"SELECT q, valid, shared, CASE WHEN valid = 0 THEN 'blind_spot' WHEN valid > 1 AND shared > 50 THEN 'consensus' ELSE 'dissensus' END AS verdict, first FROM (SELECT q, count(*) FILTER (ok) AS valid, CASE WHEN count(*) FILTER (ok) = 0 THEN 0 ELSE 30 + 30 * (q % 2) + CASE WHEN count(DISTINCT left(text, 1)) FILTER (ok) = 1 THEN 3 ELSE 0 END END AS shared, arg_min(provider, priority) FILTER (ok) AS first FROM {_ANSWERED} GROUP BY q)")
def l4_provider_rows(spark, read):
    """First success by priority, longest passage in common, verdict."""
    from lexloom.functions.udfs import common_fragment

    good = F.when(F.col("ok"), F.struct("priority", "provider", "text"))
    rows = _ANSWERED(read).groupBy("q").agg(F.array_sort(F.collect_list(good)).alias("g")).withColumn("valid", F.size("g").cast("long"))
    rows = rows.withColumn("fragment", common_fragment(F.transform("g", lambda x: x["text"])))
    return rows.select("q", "valid", F.length("fragment").cast("long").alias("shared"), K.verdict(F.col("valid"), F.col("fragment")).alias("verdict"), F.get("g", F.lit(0))["provider"].alias("first"))


_SURE_OF = Source("lineitem", "l_orderkey", "l_linenumber", "CASE WHEN l_linenumber % 3 = 0 THEN l_discount * 30 - 1 END AS number", pick("l_linenumber", "NULL", "(l_suppkey % 150) || '%'", "'high'") + " AS text")


@query(f"SELECT l_orderkey, l_linenumber, round(coalesce(greatest(0.0, least(1.0, coalesce(number, TRY_CAST(replace(text, '%', '') AS DOUBLE) / 100))), 0.8), 6)::DOUBLE AS confidence FROM {_SURE_OF}")
def f49_confidence_rows(spark, read):
    """confidences clamped; texts are percentages; a default."""
    return _SURE_OF(read).select("l_orderkey", "l_linenumber", F.round(K.confidence(F.col("number"), F.col("text")), 6).alias("confidence"))


@query("SELECT l_orderkey, CASE WHEN hits > 0 THEN hits::DOUBLE / len(e) ELSE 0.0 END AS recall, CASE WHEN hits > 0 THEN round(hits::DOUBLE / n, 9) ELSE 0.0 END AS precision FROM (SELECT l_orderkey, e, n, len(list_intersect(f, e)) AS hits FROM (SELECT l_orderkey, coalesce(list(DISTINCT l_suppkey % 5) FILTER (l_linenumber <= 4), []) AS f, count(*) FILTER (l_linenumber <= 4) AS n, coalesce(list(DISTINCT l_suppkey % 5) FILTER (l_linenumber >= 4), []) AS e FROM lineitem GROUP BY l_orderkey))")
def u4_measure_rows(spark, read):
    """Recall and precision of lists with repeats and empties."""
    pick_ = lambda c: F.collect_list(F.when(c, F.col("l_suppkey") % 5))
    lists = read("lineitem").groupBy("l_orderkey").agg(pick_(F.col("l_linenumber") <= 4).alias("found"), pick_(F.col("l_linenumber") >= 4).alias("expected"))
    return lists.select("l_orderkey", N.measures(F.col("found"), F.col("expected")).alias("m")).select("l_orderkey", "m.recall", F.round("m.precision", 9).alias("precision"))


# ---- analytics: products, rubrics, variables, health, previews ----------------------------------

_RATE = "l_discount * 0.9 + 0.0123"


@query(f"SELECT l_orderkey, round(f, 6) AS all_fail, round(g, 6) AS all_pass, round(1 - f - g, 6) AS mixed FROM (SELECT l_orderkey, product({_RATE}) AS f, product(1.0 - ({_RATE})) AS g FROM lineitem GROUP BY 1)")
def a17_expectation_rows(spark, read):
    """Products of rates, and what is neither."""
    rows = read("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.expr(_RATE)).alias("p"))
    rows = rows.select("l_orderkey", vectors.product(F.col("p")).alias("f"), vectors.product(F.transform("p", lambda x: 1.0 - x)).alias("g"))
    return rows.select("l_orderkey", F.round("f", 6).alias("all_fail"), F.round("g", 6).alias("all_pass"), F.round(1.0 - F.col("f") - F.col("g"), 6).alias("mixed"))


@query("SELECT l_orderkey, sum(l_quantity * l_linenumber) / 100.0 AS total FROM lineitem GROUP BY 1")
def a24_rubric_rows(spark, read):
    """Weighted rubric totals."""
    return read("lineitem").groupBy("l_orderkey").agg((F.sum(F.col("l_quantity") * F.col("l_linenumber")) / 100.0).alias("total"))


@query("SELECT 'V' || (l_partkey % 997) AS var, string_agg(DISTINCT l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus) AS vals FROM lineitem WHERE l_quantity > 45 GROUP BY 1 HAVING count(DISTINCT l_returnflag || l_linestatus) > 1")
def a26_variable_rows(spark, read):
    """Variables with different values across documents."""
    rows = read("lineitem").where("l_quantity > 45").select(F.concat(F.lit("V"), F.col("l_partkey") % 997).alias("var"), F.concat("l_returnflag", "l_linestatus").alias("val"))
    return rows.groupBy("var").agg(F.array_join(F.array_sort(F.collect_set("val")), ",").alias("vals"), F.count_distinct("val").alias("n")).where("n > 1").drop("n")


@query("SELECT o_custkey, CASE WHEN avg(CAST(o_orderstatus <> 'F' AS INT)) = 1 THEN 'green' WHEN avg(CAST(o_orderstatus <> 'F' AS INT)) >= 0.6 THEN 'yellow' ELSE 'red' END AS light FROM orders GROUP BY 1")
def r23_health_rows(spark, read):
    """All passed, most passed, or not."""
    share = F.avg((F.col("o_orderstatus") != "F").cast("int"))
    return read("orders").groupBy("o_custkey").agg(F.when(share == 1, "green").when(share >= 0.6, "yellow").otherwise("red").alias("light"))


_EDITED = Source("part", "p_partkey", "p_name || '#' || p_brand || '#' || p_type AS a", "CAST(1 + p_partkey % 40 AS INT) AS k")


@query(f"SELECT p_partkey, CASE WHEN k <= length(a) THEN k ELSE 0 END AS pos, CASE WHEN k <= length(a) THEN substr(a, greatest(k - 10, 1), k + 10 - greatest(k - 10, 1)) ELSE '' END AS around FROM {_EDITED}")
def r26_preview_rows(spark, read):
    """The first place where two texts differ, with ten characters on either side."""
    b = F.when(F.col("k") <= F.length("a"), F.concat(F.left("a", F.col("k") - 1), F.lit("*"), F.expr("substr(a, k + 1)"))).otherwise(F.col("a"))
    return _EDITED(read).withColumn("b", b).select("p_partkey", T.first_difference(F.col("a"), F.col("b")).alias("x")).select("p_partkey", "x.pos", "x.around")


@query("SELECT c.conv_id, k.condition, p.path FROM conversations c, (VALUES ('full', ''), ('no citation', 'CITATION'), ('no core', 'ALL')) k(condition, drops), (VALUES ('core/CITATION_POLICY'), ('core/ROLE'), ('core/GATE')) p(path) WHERE c.turn = 0 AND drops <> 'ALL' AND (drops = '' OR NOT contains(path, drops))")
def r13_query_conditions(spark, read):
    """Every query under every condition, with the condition's load plan; conditions and paths are a few literals."""
    plan = F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(p).alias("path")) for c, drops in (("full", ""), ("no citation", "CITATION"), ("no core", "ALL")) for p in ("core/CITATION_POLICY", "core/ROLE", "core/GATE") if drops != "ALL" and not (drops and drops in p)])
    return read("conversations").where("turn = 0").select("conv_id", F.explode(plan).alias("x")).select("conv_id", "x.condition", "x.path")


@query("SELECT 'r' || (user_id % 5) AS reviewer, event_type || event_id AS finding, count(*) OVER (PARTITION BY user_id % 5) AS n FROM events")
def r25_finding_rows(spark, read):
    """Findings of all reviewers, each with its reviewer and how many that one has."""
    rows = read("events").groupBy(F.concat(F.lit("r"), F.col("user_id") % 5).alias("reviewer"), "user_id").agg(F.collect_list(F.concat("event_type", F.col("event_id").cast("string"))).alias("findings"))
    total = rows.groupBy("reviewer").agg(F.sum(F.size("findings")).alias("n"))
    return rows.join(total, "reviewer").select("reviewer", F.explode("findings").alias("finding"), "n")


# ---- tables: orders of articles, snapshots, changes, load plans, keys ---------------------------

_NUMBERED = Source("lineitem", "l_partkey", "l_orderkey * 10 + l_linenumber AS id", "CASE WHEN l_suppkey % 9 = 0 THEN 'A' || l_linenumber WHEN l_suppkey % 2 = 0 THEN (l_suppkey % 30) || '-' || l_linenumber ELSE '' || (l_suppkey % 30) END AS no")


@query(f"SELECT id, row_number() OVER (PARTITION BY l_partkey ORDER BY coalesce(TRY_CAST(split_part(no, '-', 1) AS INT), 2147483647), coalesce(TRY_CAST(split_part(no, '-', 2) AS INT), 0), no, id) AS pos FROM {_NUMBERED}")
def t6_order_rows(spark, read):
    """Natural article order within each law; letters do not fail."""
    return _NUMBERED(read).select("id", F.row_number().over(Window.partitionBy("l_partkey").orderBy(*T.article_order(F.col("no")), "id")).cast("long").alias("pos"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0")
def t10_tracked_list(spark, read):
    """What is tracked, by name."""
    return read("customer").where("c_custkey % 2 = 0").select("c_custkey", "c_name").orderBy("c_name", "c_custkey")


@query("SELECT o_custkey AS pcode, CAST(o_orderkey AS VARCHAR) AS version, '1-1' AS article_no, o_orderstatus AS text FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_custkey, CAST(o_orderkey AS VARCHAR), '2', o_orderpriority FROM orders WHERE o_orderkey % 7 <> 0")
def s4_snapshot_json_rows(spark, read):
    """Nested snapshot JSON, one text for each law, as rows; internal versions are left out."""
    key = F.concat(F.when(F.col("o_orderkey") % 7 == 0, "_").otherwise(""), F.col("o_orderkey").cast("string"))
    each = F.struct(key.alias("key"), F.create_map(F.lit("1-1"), "o_orderstatus", F.lit("2"), "o_orderpriority").alias("value"))
    laws = read("orders").groupBy(F.col("o_custkey").alias("pcode")).agg(F.to_json(F.map_from_entries(F.collect_list(each))).alias("j"))
    return V.snapshot_rows(laws, "pcode", "j")


@query("SELECT 'ignore' AS mode, c_custkey AS k, c_mktsegment AS level FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT 'ignore', c_custkey, 'NEW' FROM customer WHERE c_custkey % 6 = 0 UNION ALL SELECT 'replace', c_custkey, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 2 = 1 UNION ALL SELECT 'replace', c_custkey, 'NEW' FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'delete', c_custkey, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 2 = 1 UNION ALL SELECT 'update', c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'NEW' ELSE c_mktsegment END FROM customer WHERE c_custkey % 3 <> 0")
def m1_change_rows(spark, read):
    """M1, M2, M3: insert-or-ignore, insert-or-replace, delete and update of a keyed table."""
    all_ = read("customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("level"))
    base, new = all_.where("k % 3 != 0"), all_.where("k % 2 = 0").withColumn("level", F.lit("NEW"))
    sets = {"ignore": V.insert_ignore(base, new, ["k"]), "replace": V.upsert(base, new, ["k"]), "delete": base.join(new, "k", "left_anti"), "update": base.join(new.toDF("k", "to"), "k", "left").select("k", F.coalesce("to", "level").alias("level"))}
    out = None
    for mode, rows in sets.items():
        rows = rows.select(F.lit(mode).alias("mode"), "k", "level")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT n.n_name AS task, path, row_number() OVER (PARTITION BY n.n_name ORDER BY min(place)) AS pos FROM nation n JOIN (SELECT '*' AS task, r_name AS path, r_regionkey AS place FROM region UNION ALL SELECT n_name, r_name, 10000 FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT n_name, n_name, 10001 FROM nation) l ON l.task = '*' OR l.task = n.n_name GROUP BY n.n_name, path")
def u7_load_rows(spark, read):
    """Core layers first, then the task's, each path once; the core is a counted few rows and is sent along as one array."""
    nation, region = read("nation"), read("region")
    core = _few(region.select(F.col("r_name").alias("path"), F.col("r_regionkey").cast("int").alias("at")), "path", "at").withColumnRenamed("d", "core")
    own = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("task"), F.explode(F.array(F.struct(F.col("r_name").alias("path"), F.lit(10000).alias("at")), F.struct(F.col("n_name").alias("path"), F.lit(10001).alias("at")))).alias("x"))
    both = own.unionByName(nation.select(F.col("n_name").alias("task")).join(F.broadcast(core)).select("task", F.explode("core").alias("x")))
    once = both.select("task", "x.*").groupBy("task", "path").agg(F.min("at").alias("at"))
    return once.select("task", "path", F.row_number().over(Window.partitionBy("task").orderBy("at")).cast("long").alias("pos"))


@query("SELECT l_partkey, l_linenumber FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01' UNION SELECT l_partkey, l_linenumber FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'")
def u3_key_union(spark, read):
    """The keys of two snapshots, each once."""
    year = lambda y: read("lineitem").where((F.col("l_shipdate") >= F.lit(f"{y}-01-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit(f"{y + 1}-01-01").cast("timestamp_ntz"))).select("l_partkey", "l_linenumber")
    return year(1995).union(year(1996)).distinct()


_BLANK = Source("documents", "doc_id", pick("doc_id", "text", "' \t '", "'　'", "NULL", "text") + " AS body")


@query(f"SELECT doc_id FROM {_BLANK} WHERE length(regexp_replace(coalesce(body, ''), '[\\s\\x{{3000}}\\x{{00a0}}]+', '', 'g')) > 0")
def p11_nonempty(spark, read):
    """Extracted texts that hold more than blanks."""
    return _BLANK(read).where(F.length(T.squeezed(F.coalesce("body", F.lit("")))) > 0).select("doc_id")


_CUT = Source("part", "p_partkey", "CAST(1 + p_size % 9 AS INT) AS i", "CAST(1 + p_partkey % 11 AS INT) AS j")


@query(f"SELECT p_partkey, '=' || repeat('x', i) || '|-甲|=' || repeat('y', j) || '|+乙' AS ops, '-甲 | +乙' AS summary FROM {_CUT}")
def x2_operation_rows(spark, read):
    """X-2, F56: a longest common subsequence as operations, and the short summary of its changes."""
    from lexloom.functions.udfs import char_diff

    x, y = F.expr("repeat('x', i)"), F.expr("repeat('y', j)")
    rows = _CUT(read).select("p_partkey", F.concat(x, F.lit("甲"), y).alias("old"), F.concat(x, y, F.lit("乙")).alias("new")).withColumn("ops", char_diff("old", "new"))
    return rows.select("p_partkey", F.array_join(F.transform("ops", lambda o: F.concat(o["t"], o["s"])), "|").alias("ops"), V.summary("ops").alias("summary"))


# ---- graphs and documents of judgments ----------------------------------------------------------


@query("SELECT DISTINCT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)")
def j16_dangling_rows(spark, read):
    """Edges with an end that is no node."""
    nodes = read("customer").where("c_custkey % 10 != 0").selectExpr("'c' || c_custkey AS id").union(read("orders").selectExpr("'o' || o_orderkey"))
    return G.dangling(nodes, read("orders").selectExpr("'c' || o_custkey AS src", "'o' || o_orderkey AS dst", "'has_part' AS type")).select("src", "dst")


@query("SELECT 'art-' || c_custkey AS id, to_json({'id': 'art-' || c_custkey, 'label': c_name, 'type': 'Article', 'metadata': {'text': c_mktsegment}})::VARCHAR AS json FROM customer UNION ALL SELECT 'con-' || s_suppkey, to_json({'id': 'con-' || s_suppkey, 'label': s_name, 'type': 'Concept', 'metadata': {'text': 'n' || s_nationkey}})::VARCHAR FROM supplier")
def r21_graph_entities(spark, read):
    """Articles and concepts with their ids, written as JSON and read back."""
    made = G.entities(read("customer"), "Article", F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")).unionByName(G.entities(read("supplier"), "Concept", F.col("s_suppkey"), F.col("s_name"), F.expr("'n' || s_nationkey")))
    again = G.entities_of_json(made.select(G.entity_json().alias("json")), "json")
    return again.select("id", G.entity_json().alias("json"))


_FOUND = f"SELECT query_id, id, score, entity FROM (SELECT q.vec_id AS query_id, p.vec_id AS id, 'n' || (p.label * 3) AS entity, round({_COS}, 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 9) DESC, p.vec_id) AS rank FROM embeddings q, embeddings p WHERE q.vec_id % 100 = 0) WHERE rank <= 5"


@query(f"WITH e AS ({_EDGES}), v AS ({_NODES}), f AS ({_FOUND}) SELECT f.query_id, f.id, f.score, v.label AS entity, CASE WHEN v.id IS NOT NULL THEN coalesce((SELECT string_agg(u.label, ',' ORDER BY u.label) FROM e JOIN v u ON u.id = e.src WHERE e.dst = v.id AND e.type = 'has_part'), '') END AS above, CASE WHEN v.id IS NOT NULL THEN (SELECT count(DISTINCT u.label) FROM e JOIN v u ON u.id = e.dst WHERE e.src = v.id AND e.type = 'has_part') END AS n_below FROM f LEFT JOIN v ON v.id = f.entity")
def g7_graph_retrieval(spark, read):
    """The nearest points of each query, each with its entity's surroundings in the graph; null where it has no entity."""
    nodes, edges = _graph(read)
    e = read("embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    points = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.expr("'n' || (label * 3)").alias("entity"))
    found = G.retrieve(queries, points, nodes, edges, 5, depth=1, lists=("above",))
    return found.select("query_id", "id", F.round("score", 6).alias("score"), F.col("label").alias("entity"), F.array_join("above", ",").alias("above"), "n_below")


_JUDGED = Source(
    "orders", "o_orderkey AS id", "'doc' || (o_orderkey % 50) AS doc_id", pick("o_custkey", *quoted("supreme", "high", "district", "local")) + " AS court_level", pick("o_custkey", *quoted("民事", "刑事", "行政", "家事", "少年", "其他")) + " AS case_type",
    pick("o_orderkey", *quoted("原告勝", "不明", "平手")) + " AS holding", pick("o_orderkey", *quoted("facts", "reasoning", "issues", "notes")) + " AS chunk_type", "CAST(o_orderkey % 5 - 1 AS INT) AS chunk_index", "repeat('x', CAST(5 + o_orderkey % 9 AS INT)) AS chunk_text", "'doc' || (o_custkey % 50) AS chunk_doc",
)
_DOMAINS = {"court_level": "court_level = 'local'", "case_type": "case_type = '其他'", "holding": "holding = '平手'", "chunk_type": "chunk_type = 'notes'", "chunk_index": "chunk_index < 0", "chunk_text": "length(chunk_text) < 10", "chunk doc_id": "chunk_doc <> doc_id"}


@query(f"SELECT id, problem FROM (SELECT id, unnest([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _DOMAINS.items())}]) AS problem FROM {_JUDGED}) WHERE problem IS NOT NULL")
def r29_judgment_problems(spark, read):
    """Domains of a judgment's columns, and chunks of another document."""
    return R.judgment_problems(_JUDGED(read)).select("id", "problem")


_LONG = Source("conversations", "conv_id", "role", "text")


@query(f"SELECT conv_id, turns, to_json({{'query_id': conv_id, 'query_text': left(first, 80), 'answer': left(last, 200), 'models': turns}})::VARCHAR AS json FROM (SELECT conv_id, count(*) AS turns, arg_min(replace(text, chr(10), ' '), turn) AS first, arg_max(replace(text, chr(10), ' '), turn) AS last FROM conversations GROUP BY 1)")
def r9_serialised(spark, read):
    """Reports as JSON with cut texts, other columns left out."""
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    rows = read("conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.min_by(flat, "turn").alias("first"), F.max_by(flat, "turn").alias("last"))
    return rows.select("conv_id", "turns", F.to_json(F.struct(F.col("conv_id").alias("query_id"), F.left("first", F.lit(80)).alias("query_text"), F.left("last", F.lit(200)).alias("answer"), F.col("turns").alias("models"))).alias("json"))


def _literals(rows: list[tuple[str, ...]], columns: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(quoted(*r)) + ')' for r in rows)}) AS t({columns}))"


@fixture(f"WITH v AS {_literals(seed.node_rows(), 'id, label, type')}, e AS {_literals(seed.edge_rows(), 'src, dst, type')} SELECT id, label, type, (SELECT count(*) FROM e WHERE src = id) AS n_out, (SELECT count(*) FROM e WHERE dst = id AND e.type = 'has_part') AS n_above FROM v")
def s14_seed_graph(spark, read):
    """The seed graph's nodes with the number of their edges."""
    nodes, edges = seed.graph(spark)
    out, up = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out")), edges.where("type = 'has_part'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_above"))
    return nodes.join(out, "id", "left").join(up, "id", "left").select("id", "label", "type", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_above", F.lit(0)).alias("n_above"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS pcode, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS level, CASE WHEN c_custkey % 3 = 1 THEN 30 ELSE 7 END AS frequency_days, baseline_version IS NULL AS unseen FROM (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN '19960101' END AS baseline_version FROM customer)")
def s6_tracking_rows(spark, read):
    """Rows in the tracker's schema, with its defaults."""
    rows = read("customer").selectExpr("c_custkey AS pcode", "c_name AS name", "CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS level", "CASE WHEN c_custkey % 3 = 1 THEN 30 END AS frequency_days", "CASE WHEN c_custkey % 2 = 0 THEN '19960101' END AS baseline_version")
    return tables.fitted(rows, "tracked_regulations").select("pcode", "name", "level", "frequency_days", F.col("baseline_version").isNull().alias("unseen"))


_SEEDED = _literals([(n, label, kind, str(k), ";".join(f"{a}={b}" for a, b in seed.METADATA.get(n, {}).items())) for k, (n, label, kind) in enumerate(seed.node_rows())], "id, label, type, place, known")


@query(f"SELECT id, label, type, CAST(place AS INT) AS place, CASE WHEN text IS NULL THEN known ELSE 'text=' || text END AS metadata FROM {_SEEDED} LEFT JOIN (SELECT 'art-' || l_partkey || CASE WHEN l_suppkey % 4 = 3 THEN '-' || l_linenumber ELSE '' END AS article, min(l_returnflag || l_linenumber) AS text FROM lineitem GROUP BY 1) ON article = id")
def s14_seed_texts(spark, read):
    """The seed graph in its order of insertion, with what is known of its parts, and texts from landed articles."""
    nodes, _ = seed.graph(spark)
    number = F.concat(F.col("l_partkey").cast("string"), F.when(F.col("l_suppkey") % 4 == 3, F.concat(F.lit("-"), F.col("l_linenumber").cast("string"))).otherwise(""))
    articles = read("lineitem").select(number.alias("article_no"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text"))
    shown = F.array_join(F.transform(F.map_entries("metadata"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";")
    return seed.with_texts(nodes, articles).select("id", "label", "type", "place", shown.alias("metadata"))
