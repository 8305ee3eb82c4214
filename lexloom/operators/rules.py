"""Rule tables applied to texts: routing, answer validation, governance, gates, document rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom import lexicon
from lexloom.functions import text as T


def route(text: Column) -> Column:
    """The task of a question: safety first, then simulation, then by order; some safety words give way to a simulation."""
    cjk = r"\x{4e00}-\x{9fff}"
    alone = text.rlike(rf"(^|[^{cjk}]){lexicon.SAFETY_CHARACTER}|{lexicon.SAFETY_CHARACTER}([^{cjk}]|$)")
    simulated = T.any_of(text, lexicon.TASK_WORDS["SIMULATION"])
    out = F.when(T.any_of(text, lexicon.SAFETY_ALWAYS), "SAFETY").when(simulated, "SIMULATION").when(T.any_of(text, lexicon.SAFETY_IN_CONTEXT) | alone, "SAFETY")
    for task in lexicon.TASK_ORDER:
        out = out.when(T.any_of(text, lexicon.TASK_WORDS[task]), task)
    return out.otherwise(lexicon.DEFAULT_TASK)


def task_name(task: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in lexicon.TASK_NAMES.items() for x in kv])[task], task)


def validate_answer(text: Column, task: Column) -> Column:
    """The answer, with advice appended if it shows fewer than a third of its task's patterns."""
    out = None
    for name, (patterns, hint) in lexicon.ANSWER_PATTERNS.items():
        few = T.hits(text, patterns) < max(1, len(patterns) // 3)
        advised = F.concat(text, F.lit(lexicon.ADVISORY.format(task=name, hint=hint)))
        case = (task == name) & few & (F.length(text) > 0)
        out = F.when(case, advised) if out is None else out.when(case, advised)
    return out.otherwise(text)


#: (invariant, severity) in order.
INVARIANTS = (("I001", "CRITICAL"), ("I002", "HIGH"), ("I003", "CRITICAL"), ("I004", "MEDIUM"), ("I005", "HIGH"), ("I006", "HIGH"))


#: Whether a text has a match of PERSONAL: each branch cut to what decides, so that no long run is tried from each of its characters.
_HAS_PERSONAL = r"[0-9]{7}|[0-9]{2}[-/][0-9]{1,2}[-/][0-9]|0[0-9]{1,2}[-\s][0-9]{6}"
_HAS_MAIL = r"[A-Za-z0-9_.+-]@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]"


def broken(text: Column) -> dict[str, Column]:
    """For each invariant whether a text breaks it."""
    cited = text.rlike(lexicon.CITATION)
    return {
        "I001": T.any_of(text, lexicon.RISK_WORDS) & ~T.any_of(text, lexicon.GUIDANCE_WORDS),
        "I002": T.any_of(text, lexicon.CLAIM_WORDS) & ~cited,
        "I003": text.rlike("(?i)" + "|".join(f"(?:{p})" for p in lexicon.FORBIDDEN)),
        "I004": T.any_of(text, lexicon.CHOICE_WORDS) & ~T.any_of(text, lexicon.ANALYSIS_WORDS),
        "I005": text.rlike(_HAS_PERSONAL) | (F.contains(text, F.lit("@")) & text.rlike(_HAS_MAIL)),
        "I006": T.any_of(text, lexicon.CONCLUSION_WORDS) & ~cited,
    }


def violations(rows: DataFrame, text: str = "text") -> DataFrame:
    """One row for each broken invariant of each row, in order, with what was found."""
    found = broken(F.col(text))
    personal = F.array_join(F.transform(F.regexp_extract_all(F.col(text), F.lit(f"({lexicon.PERSONAL})"), F.lit(1)), lambda m: F.concat(F.left(m, F.lit(3)), F.lit("***"))), ",")
    risky = F.array_join(F.filter(F.array(*[F.lit(w) for w in lexicon.RISK_WORDS]), lambda w: F.contains(F.col(text), w)), ",")
    detail = {"I001": risky, "I005": personal}
    each = F.array(*[F.when(found[i], F.struct(F.lit(i).alias("invariant"), F.lit(s).alias("severity"), detail.get(i, F.lit("")).alias("detail"))) for i, s in INVARIANTS])
    return rows.withColumn("v", F.explode(F.filter(each, lambda v: v.isNotNull()))).select(*rows.columns, "v.*")


def violation_counts(rows: DataFrame, text: str = "text") -> DataFrame:
    """(invariant, severity, n): how many rows break each invariant, in one aggregate over the rows."""
    found = broken(F.col(text))
    counted = rows.agg(*[F.count_if(found[i]).alias(i) for i, _ in INVARIANTS])
    each = F.array(*[F.struct(F.lit(i).alias("invariant"), F.lit(s).alias("severity"), F.col(i).alias("n")) for i, s in INVARIANTS])
    return counted.select(F.explode(each).alias("x")).select("x.*").where("n > 0")


def issues(rows: DataFrame, raw: str) -> DataFrame:
    """One row for each issue of an answer: the last list in a fence, a bare or wrapped list, or one inside other text; blank issues are dropped, missing places are numbered."""
    kind = "array<struct<issue:string,location:string>>"
    wrapped = lambda x: F.from_json(x, f"struct<issues:{kind}>")["issues"]
    fenced = F.transform(F.regexp_extract_all(raw, F.lit(r"(?s)```(?:json)?\s*(.*?)```"), F.lit(1)), lambda x: F.coalesce(F.from_json(x, kind), wrapped(x)))
    tries = F.coalesce(
        F.try_element_at(F.filter(fenced, lambda x: F.size(x) > 0), F.lit(-1)),
        F.when(F.col(raw).startswith("["), F.from_json(raw, kind)),
        F.when(F.col(raw).startswith("{"), wrapped(F.col(raw))),
        F.from_json(F.regexp_extract(raw, r"(?s)(\[\s*\{.*\}\s*\])", 1), kind),
    )
    found = rows.select(*rows.columns, F.posexplode(tries).alias("pos", "x")).where("trim(x.issue) != ''")
    return found.select(*rows.columns, F.coalesce("x.location", F.concat(F.lit("item_"), F.col("pos").cast("string"))).alias("location"), "x.issue")


def judgment_problems(rows: DataFrame) -> DataFrame:
    """One row for each column of a judgment and its chunk that is outside its domain, and for chunks of another document."""
    c = F.col
    checks = {
        "court_level": ~c("court_level").isin(*lexicon.COURT_LEVELS), "case_type": ~c("case_type").isin(*lexicon.JUDGMENT_TYPES), "holding": ~c("holding").isin(*lexicon.HOLDINGS),
        "chunk_type": ~c("chunk_type").isin(*lexicon.CHUNK_TYPES), "chunk_index": c("chunk_index") < 0, "chunk_text": F.length("chunk_text") < lexicon.MIN_CHUNK, "chunk doc_id": c("chunk_doc") != c("doc_id"),
    }
    return rows.withColumn("problem", F.explode(F.filter(F.array(*[F.when(bad, F.lit(n)) for n, bad in checks.items()]), lambda p: p.isNotNull())))


def gates(text: Column) -> dict[str, Column]:
    """G1 to G5, true where a prompt passes."""
    low, words = F.lower(text), F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    double = [T.occurrences(text, b) for b in ("{{", "}}")]
    single = [T.occurrences(text, b) - 2 * d for b, d in zip(("{", "}"), double, strict=True)]
    return {
        "G1": reduce(lambda a, b: a & b, [low.contains(s) for s in lexicon.SECTIONS]),
        "G2": words >= lexicon.MIN_PROMPT_WORDS,
        "G3": T.hits(text, lexicon.STOCK_PHRASES) * 1000.0 <= F.greatest(words, F.lit(1)),
        "G4": text.contains("例如") | low.contains("example") | text.contains("{") | text.contains("```"),
        "G5": (double[0] == double[1]) & (single[0] == single[1]),
    }


def gate_report(rows: DataFrame, text: str = "text") -> DataFrame:
    """Each gate as a column, how many passed, and whether all did."""
    each = gates(F.col(text))
    out = rows.select(*rows.columns, *[c.alias(g) for g, c in each.items()])
    passed = reduce(lambda a, b: a + b, [F.col(g).cast("int") for g in each])
    return out.withColumn("passed", passed).withColumn("all_passed", F.col("passed") == len(each))


def meta_problems(rows: DataFrame) -> DataFrame:
    """Document metadata with the names of its problems."""
    lacks = [F.when(F.col(f).isNull(), F.lit(f"missing {f}")) for f in lexicon.META_FIELDS]
    more = [
        F.when(~F.col("status").isin(*lexicon.META_STATUSES), F.lit("status")),
        F.when((F.col("status") == "final") & F.col("reviewer").isNull(), F.lit("final without reviewer")),
        F.when(~F.col("doc_id").rlike(lexicon.DOC_ID), F.lit("doc_id format")),
    ]
    return rows.withColumn("problems", F.filter(F.array(*lacks, *more), lambda p: p.isNotNull()))


def unknown_variables(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(f"({lexicon.VARIABLE})"), F.lit(1)), lambda v: ~v.rlike(lexicon.KNOWN_VARIABLE))


def rate_ok(rate: Column) -> Column:
    return F.coalesce(rate.try_cast("double").between(0, lexicon.MAX_RATE), F.lit(False))


def missing(present: Column, required) -> Column:
    return F.array_except(F.array(*[F.lit(r) for r in required]), present)


def query_problems() -> Column:
    """Messages on an evaluation query row (id, version, route, difficulty, safety_level, trigger, confidence, rq array)."""
    c = F.col
    checks = [
        *[F.when(c(f).isNull(), F.lit(f"missing {f}")) for f in ("id", "version", "route", "difficulty")],
        F.when(~c("id").rlike("^Q[0-9]{3}$"), F.lit("id format")),
        F.when(~c("version").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit("version format")),
        F.when(~c("route").isin(*lexicon.ROUTES), F.lit("route")),
        F.when(~c("difficulty").isin(*lexicon.DIFFICULTIES), F.lit("difficulty")),
        F.when(~c("safety_level").isin(*lexicon.SAFETY_LEVELS), F.lit("safety_level")),
        F.when(~c("trigger").isin(*lexicon.GATE_TRIGGERS), F.lit("expected_gate_trigger")),
        F.when(~c("confidence").isin(*lexicon.CONFIDENCES), F.lit("expected_confidence")),
        F.when((c("route") == "SAFETY") & (c("safety_level") == "N/A"), F.lit("safety route without level")),
        F.when((c("difficulty") == "EDGE_CASE") & ~F.array_contains("rq", "RQ3"), F.lit("warning: edge case without RQ3")),
    ]
    return F.filter(F.array(*checks), lambda m: m.isNotNull())


def fabrication(text: Column, first: bool = True) -> Column:
    """Marks of invented citations in an answer, by the first or the second rule set."""
    top, marks, dash = (9, lexicon.CONFIDENCE_MARKS, "-") if first else (14, lexicon.SHORT_CONFIDENCE_MARKS, r"-\x{2013}")
    numeric = text.rlike(r"\[[1-9]\]" if top == 9 else r"\[([1-9]|1[0-4])\]")
    cited, sure, refs = text.contains("[T") | numeric, T.any_of(text, marks), F.size(T.articles_cited(text, dash))
    issues = (refs > lexicon.MAX_ARTICLES).cast("int") + (~cited).cast("int") + (~sure).cast("int")
    return F.struct(cited.alias("has_citation"), sure.alias("has_confidence"), refs.alias("article_refs"), issues.alias("issue_count"))
