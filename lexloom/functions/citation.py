"""Citations, status statements and case numbers: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom import lexicon

from .text import hits


def normalize(text: Column) -> Column:
    """One form for interpretations, section signs, precedents and article numbers; bare articles count as the civil code's."""
    words = "|".join(sorted(lexicon.PRECEDENT_WORDS, key=len, reverse=True))
    x = F.regexp_replace(text, r"釋字?\s*(?:第\s*)?([0-9]+(?:之[0-9]+)?)\s*號", "釋字第$1號")
    x = F.regexp_replace(x, "§([0-9]+)", "民法第$1條")
    x = F.regexp_replace(x, rf"([0-9]+)(?:年度)?\s*({words})\s*([0-9]+)\s*號?", "$1年度$2字第$3號")
    x = F.replace(x, F.lit("字第字第"), F.lit("字第"))
    x = F.regexp_replace(x, "第([0-9]+(?:之[0-9]+)?)條", "民法第$1條")
    return F.replace(x, F.lit("民法民法"), F.lit("民法"))


def status(text: Column) -> Column:
    """(status, confidence): what a text says about an article, by precedence; null if nothing."""
    short = F.length(F.trim(F.coalesce(text, F.lit("")))) < 5
    out = F.struct(F.lit(None).cast("string").alias("status"), F.lit(0.0).alias("confidence"))
    for name, ignore_case, patterns in reversed(lexicon.STATUS_PATTERNS):
        n = hits(text, patterns, ignore_case)
        sure = F.lit(0.9) if name == "error" else F.least(F.lit(0.9), F.lit(0.3) + n * 0.15)
        out = F.when(n > 0, F.struct(F.lit(name).alias("status"), sure.alias("confidence"))).otherwise(out)
    return F.when(short, F.struct(F.lit("error").alias("status"), F.lit(0.9).alias("confidence"))).otherwise(out)


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def _with(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def case_number(text: Column) -> Column:
    """(court, year, case_type, case_no, court_code) of a case number; null if there is none. The court's name is cut out where it stands."""
    names = F.array(*[F.lit(n) for n in sorted(lexicon.COURTS, key=lambda n: (-len(n), n))])

    def numbered(court: Column, rest: Column) -> Column:
        year = F.regexp_extract(rest, r"([0-9]{2,3})\s*年度", 1)
        kept = F.regexp_replace(rest, r"^(.*?)[0-9]{2,3}\s*年度", "$1 ")

        def found(kept: Column) -> Column:
            kind, number = (F.regexp_extract(kept, r"([\p{L}\p{N}_]+)\s*字\s*第\s*([0-9]+)", k) for k in (1, 2))
            return F.struct(court.alias("court"), year.alias("year"), kind.alias("case_type"), number.alias("case_no"), F.coalesce(_lookup(lexicon.COURTS, court), F.lit("")).alias("court_code"))

        return _with(kept, found)

    def in_court(x: Column) -> Column:
        return _with(F.when(x["court"] != "", F.replace(x["text"], x["court"], F.lit(" "))).otherwise(x["text"]), lambda rest: numbered(x["court"], rest))

    def named(text: Column) -> Column:
        court = F.coalesce(F.get(F.filter(names, lambda n: F.contains(text, n)), F.lit(0)), F.lit(""))
        return F.struct(text.alias("text"), court.alias("court"))

    found = _with(_with(text, named), in_court)
    return _with(found, lambda x: F.when(x["case_no"] != "", x))


def case_id(court: Column, year: Column, kind: Column, number: Column, date: Column, check: Column) -> Column:
    return F.concat_ws(",", F.coalesce(_lookup(lexicon.COURTS, court), court), year, F.coalesce(_lookup(lexicon.CASE_TYPES, kind), kind), number, date, check)


def cited_articles(text: Column) -> Column:
    """All article numbers of the raw text in order, repeats kept."""
    return F.regexp_extract_all(text, F.lit("第([0-9]+(?:之[0-9]+)?)條"), F.lit(1))
