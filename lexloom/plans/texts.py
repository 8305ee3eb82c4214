"""Text rules: normalisation, routing, validation, governance, gates, documents, composition."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom import lexicon
from lexloom.functions import citation as C
from lexloom.functions import dates as D
from lexloom.functions import text as T
from lexloom.operators import rules as R

from .registry import fixture, query, values


def _or(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _sum(column: str, patterns, flags: str = "") -> str:
    quoted = [p.replace("'", "''") for p in patterns]
    return " + ".join(f"CAST(regexp_matches({column}, '{flags}{p}') AS INT)" for p in quoted)


_QUESTIONS = values(
    "text", "('我不想活了，對方知道我住哪')", "('幫我檢查這份合約的違約條款是否完整')", "('幫我查這份合約有沒有漏洞')", "('幫我寫一份訴狀')", "('對方完全抹殺我的貢獻')", "('模擬原告的攻防策略')",
    "('假設我不想活了')", "('我朋友欠我錢不還，怎麼辦')", "('殺')", "('如果他威脅我')", "('他威脅我')", "('什麼是善意第三人')", "('請幫我批改並評分')", "('比較方案A')", "('寫成摘要')", "('我要提告')", "('')",
)
_CJK = "[\\x{4e00}-\\x{9fff}]"
_ROUTE = (
    f"CASE WHEN {_or('text', lexicon.SAFETY_ALWAYS)} THEN 'SAFETY' WHEN {_or('text', lexicon.TASK_WORDS['SIMULATION'])} THEN 'SIMULATION' "
    f"WHEN {_or('text', lexicon.SAFETY_IN_CONTEXT)} OR regexp_matches(text, '(^|[^\\x{{4e00}}-\\x{{9fff}}])殺|殺([^\\x{{4e00}}-\\x{{9fff}}]|$)') THEN 'SAFETY' "
    + " ".join(f"WHEN {_or('text', lexicon.TASK_WORDS[t])} THEN '{t}'" for t in lexicon.TASK_ORDER) + " ELSE 'CONSULTANT' END"
)


@fixture(f"SELECT text, {_ROUTE} AS task FROM {_QUESTIONS}")
def f19_routes(spark, read):
    """the task of each question."""
    return spark.sql(f"SELECT * FROM {_QUESTIONS}").select("text", R.route(F.col("text")).alias("task"))


@query(f"SELECT {_ROUTE} AS task, count(*) AS n FROM (SELECT text FROM conversations) GROUP BY 1")
def a12_route_counts(spark, read):
    """How often each task is asked for."""
    return read("conversations").groupBy(R.route(F.col("text")).alias("task")).agg(F.count("*").alias("n"))


_LATIN = ("secret", "token", "password", "license", "email")


@query(f"SELECT source, count(*) AS docs, count(*) FILTER ({_or('lower(text)', _LATIN)}) AS flagged FROM documents GROUP BY source")
def p7_lexicon_flags(spark, read):
    """Documents with any of a lexicon's words, by source."""
    return read("documents").groupBy("source").agg(F.count("*").alias("docs"), F.count_if(T.any_of(F.lower("text"), _LATIN)).alias("flagged"))


_ANSWERS = values("text, task", "('這份合約看起來還可以', 'QC')", "('原告主張違約，被告抗辯不可抗力', 'LITIGATION')", "('測試內容', 'UNKNOWN')", "('', 'QC')", "('第一條條款缺失', 'QC')", "('依據判決', 'RESEARCH')", "('無關', 'SAFETY')")
_ADVISED = " ".join(f"WHEN task = '{t}' AND length(text) > 0 AND {_sum('text', p)} < {max(1, len(p) // 3)} THEN true" for t, (p, _) in lexicon.ANSWER_PATTERNS.items())


@fixture(f"SELECT text, task, CASE {_ADVISED} ELSE false END AS advised FROM {_ANSWERS}")
def f22_validated_answers(spark, read):
    """answers that lack their task's patterns get advice."""
    rows = spark.sql(f"SELECT * FROM {_ANSWERS}")
    return rows.select("text", "task", (R.validate_answer(F.col("text"), F.col("task")) != F.col("text")).alias("advised"))


_CITED = values("text, want", "('§987', '民法第987條')", "('釋字812號', '釋字第812號')", "('釋字第 812 號', '釋字第812號')", "('第1條', '民法第1條')", "('112台上9999號', '112年度台上字第9999號')", "('民法第5條', '民法第5條')", "('見§12及第3條之規定', '見民法第12條及民法第3條之規定')", "('無', '無')")


@fixture(f"SELECT text, want AS citation FROM {_CITED}")
def f13_citations(spark, read):
    """one form for citations."""
    return spark.sql(f"SELECT text FROM {_CITED}").select("text", C.normalize(F.col("text")).alias("citation"))


_STATEMENTS = values("text", "('§987 已刪除')", "('查無此條號 §9999')", "('該條文已於2007年刪除')", "('§1 規定之內容')", "('')", "('API 呼叫失敗：429 Too Many Requests')", "('抱歉，我無法回答這個問題')", "('本條已修正，現行條文修正後')", "('I CANNOT VERIFY this')")
_STATUS = "CASE WHEN length(trim(text)) < 5 THEN 'error' " + " ".join(f"WHEN {_sum('text', p, '(?i)' if i else '')} > 0 THEN '{n}'" for n, i, p in lexicon.STATUS_PATTERNS) + " END"
_SURE = "CASE WHEN length(trim(text)) < 5 THEN 0.9 " + " ".join(f"WHEN {_sum('text', p, '(?i)' if i else '')} > 0 THEN {'0.9' if n == 'error' else 'least(0.9, 0.3 + 0.15 * (' + _sum('text', p, '(?i)' if i else '') + '))'}" for n, i, p in lexicon.STATUS_PATTERNS) + " ELSE 0 END"


@fixture(f"SELECT text, {_STATUS} AS status, round(CAST({_SURE} AS DOUBLE), 6) AS confidence FROM {_STATEMENTS}")
def f14_statuses(spark, read):
    """what a text says about an article, and how surely."""
    s = C.status(F.col("text"))
    return spark.sql(f"SELECT * FROM {_STATEMENTS}").select("text", s["status"].alias("status"), F.round(s["confidence"].cast("double"), 6).alias("confidence"))


_CASES = values(
    "s, court, year, case_type, case_no, court_code", "('臺灣彰化地方法院 100 年度訴字第 1552 號', '彰化地方法院', '100', '訴', '1552', 'CHD')", "('臺灣高等法院高雄分院110年度上易字第333號', '臺灣高等法院高雄分院', '110', '上易', '333', 'KSH')",
    "('士林地方法院 114 年度家親聲字第 20 號', '士林地方法院', '114', '家親聲', '20', 'SLD')", "('這不是案號', NULL, NULL, NULL, NULL, NULL)", "('', NULL, NULL, NULL, NULL, NULL)",
)


@fixture(f"SELECT * FROM {_CASES}")
def f23_case_numbers(spark, read):
    """Case numbers; the court with the longest name counts."""
    return spark.sql(f"SELECT s FROM {_CASES}").select("s", C.case_number(F.col("s")).alias("c")).select("s", "c.*")


@fixture("SELECT 'TPS,112,V,9999,20230101,1' AS a, 'CHDM,100,訴,1552,20130517,2' AS b, left(sha256('法院' || '甲' || '2020'), 16) AS doc, 'd1_body_07' AS chunk")
def f24_identifiers(spark, read):
    """case ids, document ids, chunk ids."""
    lit = lambda *x: [F.lit(v) for v in x]
    return spark.range(1).select(C.case_id(*lit("最高法院", "112", "民事", "9999", "20230101", "1")).alias("a"), C.case_id(*lit("CHDM", "100", "訴", "1552", "20130517", "2")).alias("b"), T.doc_id(*lit("法院", "甲", "2020")).alias("doc"), T.chunk_id(*lit("d1", "body", 7)).alias("chunk"))


@query("SELECT page_id, regexp_extract(url, '[?&]page=([^&#]+)', 1) AS page, regexp_replace(url, '[\\\\/:*?\"<>|]', '_', 'g') AS file FROM pages")
def f10_url_parts(spark, read):
    """a query parameter, and a url as a file name."""
    return read("pages").select("page_id", F.regexp_extract("url", "[?&]page=([^&#]+)", 1).alias("page"), T.file_name(F.col("url")).alias("file"))


@query("SELECT doc_id, CAST(trunc(0.25 * length(text)) AS BIGINT) AS tokens FROM documents")
def f27_token_estimates(spark, read):
    """Estimated tokens of each document."""
    return read("documents").select("doc_id", T.tokens(F.col("text")).alias("tokens"))


_RAW = values("path, ordinal, raw", "('a.md', 1, '---\nStatus: \"draft\"\ntitle: One\nother: x\n---\nBody A')", "('b.md', 2, 'no front')", "('c.md', 3, '---\nbroken')")


@fixture("SELECT * FROM (VALUES ('a.md', 'Body A', 'draft', 'One'), ('b.md', 'no front', NULL, NULL), ('c.md', '---\nbroken', NULL, NULL)) t(path, body, status, title)")
def f28_front_matter(spark, read):
    """Documents with a front matter block."""
    return spark.sql(f"SELECT * FROM {_RAW}").select("path", T.front_matter(F.col("raw")).alias("m")).select("path", "m.body", "m.status", "m.title")


@fixture("SELECT 'status: draft\nBody A\n===\n\nno front\n' || '…' AS prompt, 9 AS tokens")
def f30_composed(spark, read):
    """documents in order under their headers, joined and cut with a mark."""
    rows = spark.sql(f"SELECT * FROM {_RAW}").withColumn("m", T.front_matter(F.col("raw")))
    part = F.concat(T.temporal_header({"status": F.col("m.status")}), F.lit("\n"), F.col("m.body"))
    whole = T.composed(rows.select(F.lit(1).alias("one"), "ordinal", part.alias("part")), "one", "ordinal", "part", "\n===\n", 35)
    return whole.select(F.col("text").alias("prompt"), T.tokens(F.col("text")).cast("int").alias("tokens"))


_LAYERS = values("task, layer_ord, file_ord, path", "('*', 1, 1, 'core/a')", "('*', 1, 2, 'core/b')", "('*', 2, 1, 'core/c')", "('QC', 1, 1, 'task/q')", "('QC', 1, 2, 'core/b')", "('REPORT', 1, 1, 'task/r')")


@fixture(f"SELECT t.task, l.path, row_number() OVER (PARTITION BY t.task ORDER BY min(CASE WHEN l.task = '*' THEN 0 ELSE 1 END * 10000 + layer_ord * 100 + file_ord)) AS pos FROM (VALUES ('QC'), ('REPORT'), ('NONE')) t(task) JOIN {_LAYERS} l ON l.task IN ('*', t.task) GROUP BY t.task, l.path")
def u7_load_plan(spark, read):
    """Core layers first, then the task's, each path once."""
    from pyspark.sql import Window

    tasks = spark.sql("SELECT * FROM VALUES ('QC'), ('REPORT'), ('NONE') AS t(wanted)")
    layers = spark.sql(f"SELECT * FROM {_LAYERS}").withColumn("at", F.when(F.col("task") == "*", 0).otherwise(10000) + F.col("layer_ord") * 100 + F.col("file_ord"))
    both = layers.where("task = '*'").crossJoin(F.broadcast(tasks)).unionByName(layers.join(F.broadcast(tasks), F.col("task") == F.col("wanted")))
    once = both.groupBy("wanted", "path").agg(F.min("at").alias("at"))
    return once.select(F.col("wanted").alias("task"), "path", F.row_number().over(Window.partitionBy("wanted").orderBy("at")).cast("long").alias("pos"))


_TEXTS = values(
    "id, text", "(1, '依具民法第1條，因此權利受損')", "(2, '依具民法第1條 [1]，因此權利受損')", "(3, '刑事案件，請見免責聲明')", "(4, '刑事案件')", "(5, '請 install_plugin x')", "(6, '建議選擇甲')", "(7, '建議選擇甲，因為便宜')",
    "(8, '電話 0912345678 信箱 a.b@c.tw')", "(9, '無')", "(10, '')",
)
_CITATION = "regexp_matches(text, '" + lexicon.CITATION + "')"
_BROKEN = {
    "I001": f"{_or('text', lexicon.RISK_WORDS)} AND NOT {_or('text', lexicon.GUIDANCE_WORDS)}",
    "I002": f"{_or('text', lexicon.CLAIM_WORDS)} AND NOT {_CITATION}",
    "I003": "(" + _sum("text", lexicon.FORBIDDEN, "(?i)") + ") > 0",
    "I004": f"{_or('text', lexicon.CHOICE_WORDS)} AND NOT {_or('text', lexicon.ANALYSIS_WORDS)}",
    "I005": f"regexp_matches(text, '{lexicon.PERSONAL}')",
    "I006": f"{_or('text', lexicon.CONCLUSION_WORDS)} AND NOT {_CITATION}",
}
_VIOLATIONS = " UNION ALL ".join(f"SELECT id, '{i}' AS invariant, '{s}' AS severity FROM ROWS WHERE {_BROKEN[i]}" for i, s in R.INVARIANTS)


@fixture(_VIOLATIONS.replace("ROWS", _TEXTS))
def f34_violations(spark, read):
    """Broken invariants, one row each."""
    return R.violations(spark.sql(f"SELECT * FROM {_TEXTS}")).select("id", "invariant", "severity")


@fixture(f"SELECT id, string_agg(left(m, 3) || '***', ',') AS found FROM (SELECT id, unnest(regexp_extract_all(text, '{lexicon.PERSONAL}')) AS m FROM {_TEXTS}) GROUP BY id")
def f40_personal_data(spark, read):
    """Personal data, shown by its first characters."""
    return R.violations(spark.sql(f"SELECT * FROM {_TEXTS}")).where("invariant = 'I005'").select("id", F.col("detail").alias("found"))


@query("SELECT severity, count(*) AS n FROM (" + _VIOLATIONS.replace("ROWS", "(SELECT doc_id AS id, text FROM documents)") + ") GROUP BY severity")
def a18_severities(spark, read):
    """A18, I001 to I006 on documents: violations by severity."""
    return R.violation_counts(read("documents").select("text")).groupBy("severity").agg(F.sum("n").alias("n"))


_GATES = "(contains(l, 'role') AND contains(l, 'task') AND contains(l, 'output') AND contains(l, 'constraint')) AS g1, n >= 50 AS g2, (contains(text, '例如') OR contains(l, 'example') OR contains(text, '{') OR contains(text, '```')) AS g4, (d1 = d2 AND s1 - 2 * d1 = s2 - 2 * d2) AS g5"
_COUNTS = "SELECT doc_id, text, lower(text) AS l, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '')) AS n, (length(text) - length(replace(text, '{{', ''))) / 2 AS d1, (length(text) - length(replace(text, '}}', ''))) / 2 AS d2, length(text) - length(replace(text, '{', '')) AS s1, length(text) - length(replace(text, '}', '')) AS s2 FROM documents"


@query(f"SELECT doc_id, g1, g2, g4, g5 FROM (SELECT doc_id, {_GATES} FROM ({_COUNTS}))")
def f41_gates(spark, read):
    """Prompt gates on documents."""
    g = R.gates(F.col("text"))
    return read("documents").select("doc_id", *[g[k].alias(k.lower()) for k in ("G1", "G2", "G4", "G5")])


_PROMPTS = values("id, text", "(1, 'ROLE task Output constraint {{a}} {b}')", "(2, '{{x}')", "(3, '')", "(4, '讓我們來 看')")


@fixture("SELECT * FROM (VALUES (1, true, false, true, true, true), (2, false, false, true, true, false), (3, false, false, true, false, true), (4, false, false, false, false, true)) t(id, g1, g2, g3, g4, g5)")
def f43_gate_fixture(spark, read):
    """F41 to F46 with stock phrases and unbalanced braces."""
    rows = R.gate_report(spark.sql(f"SELECT * FROM {_PROMPTS}"))
    return rows.select("id", *[F.col(g).alias(g.lower()) for g in ("G1", "G2", "G3", "G4", "G5")])


_META = values(
    "tlds_version, doc_id, doc_type, title, version, status, jurisdiction, language, confidential, author, reviewer", "('1', 'ZY-LOAN-20260706-0001', 'c', 't', '1', 'draft', 'TW', 'zh', true, 'a', NULL)",
    "('1', 'ZY-LOAN-2026070-0001', 'c', 't', '1', 'final', 'TW', 'zh', true, 'a', NULL)", "(NULL, 'ZY-LOAN-20260706-0002', NULL, 't', '1', 'published', 'TW', 'zh', true, 'a', 'r')",
)


@fixture("SELECT * FROM (VALUES ('ZY-LOAN-20260706-0001', ''), ('ZY-LOAN-2026070-0001', 'final without reviewer,doc_id format'), ('ZY-LOAN-20260706-0002', 'missing tlds_version,missing doc_type,status')) t(doc_id, problems)")
def f57_metadata(spark, read):
    """Problems of document metadata."""
    return R.meta_problems(spark.sql(f"SELECT * FROM {_META}")).select("doc_id", F.array_join("problems", ",").alias("problems"))


_RULED = values("id, clause, text, rate, early, late", "(1, 'CL-MORT-006-v2', '{{PartyA.Name}}', '16', '114/01/01', '114/12/31')", "(2, 'CL-LOAN-001-v', '{{Loan.Amount}} {{Amount}}', '16.1', '114/06/01', '114/06/01')", "(3, 'CL-LOAN-001', 'HV-07', 'abc', '114/12/31', '114/01/01')", "(4, 'x', '', NULL, '114/02/30', '114/01/01')")


@fixture("SELECT * FROM (VALUES (1, true, '', true, true, false), (2, false, '{{Loan.Amount}}', false, false, false), (3, true, '', false, false, true), (4, false, '', false, false, false)) t(id, clause_ok, unknown, rate_ok, dates_ok, meta_text)")
def f57_document_rules(spark, read):
    """clause ids, variables, rates, dates, meta text."""
    c = F.col
    dates = F.coalesce(D.roc_slashes(c("late")) > D.roc_slashes(c("early")), F.lit(False))
    return spark.sql(f"SELECT * FROM {_RULED}").select("id", c("clause").rlike(lexicon.CLAUSE_ID).alias("clause_ok"), F.array_join(R.unknown_variables(c("text")), ",").alias("unknown"), R.rate_ok(c("rate")).alias("rate_ok"), dates.alias("dates_ok"), c("text").rlike(lexicon.META_TEXT).alias("meta_text"))


@fixture("SELECT * FROM (VALUES (1, 'CL-LOAN-007'), (2, '')) t(id, missing)")
def j15_missing_clauses(spark, read):
    """Required clauses that a document lacks."""
    rows = spark.sql("SELECT * FROM VALUES (1, 6), (2, 7) AS t(id, n)").select("id", F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: F.format_string("CL-LOAN-%03d", k)).alias("has"))
    return rows.select("id", F.array_join(R.missing(F.col("has"), lexicon.LOAN_CLAUSES), ",").alias("missing"))


_QUERIES = values(
    "id, version, route, difficulty, safety_level, trigger, confidence, rq", "('Q001', '2026-01-01', 'QC', 'STANDARD', 'RL0', 'NONE', 'HIGH', 'RQ1')", "('X1', '2026', 'NO', 'HARD', 'RL9', 'MAYBE', 'SOME', '')", "('Q003', '2026-01-01', 'SAFETY', 'EDGE_CASE', 'N/A', 'NONE', 'LOW', 'RQ1')", "('Q004', NULL, 'QC', 'STANDARD', 'RL1', 'NONE', 'LOW', 'RQ3')",
)


@fixture("SELECT * FROM (VALUES ('Q001', ''), ('X1', 'id format,version format,route,difficulty,safety_level,expected_gate_trigger,expected_confidence'), ('Q003', 'safety route without level,warning: edge case without RQ3'), ('Q004', 'missing version')) t(id, problems)")
def f58_query_problems(spark, read):
    """Problems of evaluation queries."""
    return spark.sql(f"SELECT * FROM {_QUERIES}").withColumn("rq", F.split("rq", ",")).select("id", F.array_join(R.query_problems(), ",").alias("problems"))


_RESPONSES = values("id, text", "(1, '依第1條與第2條 [T1] ✅ 信心：高')", "(2, '第1條 第2條 第3條 第4條 第5條 第6條 第7條 第8條 第9條')", "(3, '見 [12] ✅ 信心：無')", "(4, '')")


@fixture("SELECT * FROM (VALUES (1, true, true, 2, 0, true, true, 0), (2, false, false, 9, 3, false, false, 3), (3, false, false, 0, 2, true, true, 0), (4, false, false, 0, 2, false, false, 2)) t(id, cited, sure, refs, issues, cited2, sure2, issues2)")
def f31_fabrication(spark, read):
    """Marks of invented citations by both rule sets."""
    a, b = R.fabrication(F.col("text")), R.fabrication(F.col("text"), first=False)
    return spark.sql(f"SELECT * FROM {_RESPONSES}").select("id", a["has_citation"].alias("cited"), a["has_confidence"].alias("sure"), a["article_refs"].alias("refs"), a["issue_count"].alias("issues"), b["has_citation"].alias("cited2"), b["has_confidence"].alias("sure2"), b["issue_count"].alias("issues2"))


_RAWJSON = values("id, raw", """(1, 'text ```json\n[{"issue": "a"}]\n``` and ```json\n[{"issue": "b"}, {"issue": ""}]\n```')""", """(2, '[{"issue": "c"}]')""", """(3, '{"issues": [{"issue": "d"}]}')""", """(4, 'noise [{"issue": "e"}] noise')""", "(5, 'garbage')")


@fixture("SELECT * FROM (VALUES (1, 'item_0', 'b'), (2, 'item_0', 'c'), (3, 'item_0', 'd'), (4, 'item_0', 'e')) t(id, location, issue)")
def f47_issues_from_answers(spark, read):
    """Issues out of fenced, bare, wrapped or embedded JSON; blank issues are dropped."""
    return R.issues(spark.sql(f"SELECT * FROM {_RAWJSON}"), "raw").select("id", "location", "issue")


@query("SELECT event_id, CAST(json_extract_string(props, '$.page') AS VARCHAR) AS page, length(props) AS n FROM events")
def f63_json_fields(spark, read):
    """a field of a JSON text column."""
    return read("events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.length("props").cast("long").alias("n"))


_ALIKE = values("id, a, b", "(1, '民法第1條', '第1條')", "(2, 'abcd', 'bcde')", "(3, '', '')")


@fixture("SELECT * FROM (VALUES (1, true, 0.75::DOUBLE), (2, false, 0.75), (3, true, 1.0)) t(id, equivalent, ratio)")
def f16_similarity(spark, read):
    """Equal once normalised, or an alignment ratio."""
    from lexloom.functions.udfs import similarity

    a, b = C.normalize(F.col("a")), C.normalize(F.col("b"))
    rows = spark.sql(f"SELECT * FROM {_ALIKE}").select("id", (a == b).alias("equivalent"), F.round(similarity("a", "b"), 6).alias("ratio"))
    return rows


@query("SELECT source, lang, count(*) AS docs FROM documents WHERE lang IN ('de', 'fr') AND source <> 'src1' GROUP BY 1, 2")
def p9_category_filter(spark, read):
    """Rows of the wanted categories only; the filter reaches the scan."""
    wanted = read("documents").where(F.col("lang").isin("de", "fr") & (F.col("source") != "src1"))
    return wanted.groupBy("source", "lang").agg(F.count("*").alias("docs"))
