"""Text expressions: Column in, Column out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom import lexicon


def any_of(text: Column, words) -> Column:
    """Whether a text contains any of the words."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def hits(text: Column, patterns, ignore_case: bool = False) -> Column:
    """How many of the patterns are found."""
    return reduce(lambda a, b: a + b, [text.rlike(("(?i)" if ignore_case else "") + p).cast("int") for p in patterns])


def pcode(url: Column) -> Column:
    return F.regexp_extract(url, "[?&]pcode=([^&]+)", 1)


def article_number(text: Column) -> Column:
    return F.regexp_extract(text, r"第\s*([0-9A-Za-z]+(?:-[0-9A-Za-z]+)?)\s*條", 1)


def plain(html: Column) -> Column:
    """Text of a piece of HTML: no tags, two entities, blanks collapsed, trimmed."""
    x = F.regexp_replace(html, "<[^>]+>", "")
    x = F.replace(F.replace(x, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    return F.trim(F.regexp_replace(x, r"[\s\x{3000}\x{00a0}]+", " "))


def squeezed(text: Column) -> Column:
    """Without any blanks, as articles are compared."""
    return F.regexp_replace(text, r"[\s\x{3000}\x{00a0}]+", "")


def article_order(no: Column) -> list[Column]:
    """Natural order of article numbers: main number, sub-number, then the text; letters never fail."""
    part = lambda k: F.try_element_at(F.split(no, "-"), F.lit(k)).try_cast("int")
    return [F.coalesce(part(1), F.lit(2**31 - 1)), F.coalesce(part(2), F.lit(0)), no]


def tokens(text: Column) -> Column:
    """Estimated tokens: 1.5 to a Chinese character, a quarter to any other."""
    cjk = F.length(text) - F.length(F.regexp_replace(text, r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]", ""))
    return (cjk * 1.5 + (F.length(text) - cjk) * 0.25).cast("long")


def front_matter(raw: Column) -> Column:
    """(body, status, as_of_date, version, title) of a document that may begin with a --- block."""
    parts = F.split(raw, "---", 3)
    has = raw.startswith("---") & (F.size(parts) == 3)
    field = lambda k: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(parts[1], rf"(?im)^\s*{k}\s*:[ \t]*(.*?)[ \t]*$", 1), "^[\"']|[\"']$", "")), F.lit(""))
    return F.struct(
        F.when(has, F.trim(F.regexp_replace(F.get(parts, F.lit(2)), r"^\s+|\s+$", ""))).otherwise(raw).alias("body"),
        *[F.when(has, field(k)).alias(k) for k in ("status", "as_of_date", "version", "title")],
    )


def temporal_header(meta: dict[str, Column]) -> Column:
    """The present parts of a document's dating, joined by bars."""
    return F.concat_ws(" | ", *[F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{k}: "), c)) for k, c in meta.items()])


def section_numbers(title: Column) -> Column:
    """The distinct article numbers behind section signs."""
    return F.array_distinct(F.regexp_extract_all(title, F.lit("§([0-9]+(?:-[0-9]+)?)"), F.lit(1)))


def composed(parts: DataFrame, key: str, order: str, part: str, between: str, limit: int) -> DataFrame:
    """(key, text): each key's parts in order, joined, and cut with a mark at the limit."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, part))), lambda x: x[part])
    whole = parts.groupBy(key).agg(F.array_join(ordered, between).alias("text"))
    return whole.withColumn("text", F.when(F.length("text") > limit, F.concat(F.left("text", F.lit(limit)), F.lit("…"))).otherwise(F.col("text")))


def first_difference(a: Column, b: Column, around: int = 10) -> Column:
    """(pos, around): the first place where two texts differ, from 1, and the first text about it; 0 and nothing where they agree."""
    places = F.sequence(F.lit(1), F.greatest(F.length(a), F.length(b), F.lit(1)))
    pos = F.coalesce(F.get(F.filter(places, lambda k: F.coalesce(F.substring(a, k, F.lit(1)), F.lit("")) != F.coalesce(F.substring(b, k, F.lit(1)), F.lit(""))), F.lit(0)), F.lit(0))
    low = F.greatest(pos - around, F.lit(1))
    return F.struct(pos.alias("pos"), F.when(pos > 0, F.substring(a, low, pos + around - low)).otherwise("").alias("around"))


def file_name(text: Column) -> Column:
    return F.regexp_replace(text, r'[\\/:*?"<>|]', "_")


def characters(text: Column, first: int = 40) -> Column:
    """The distinct characters of the beginning, lower-cased, without blanks and the two commonest marks."""
    return F.array_distinct(F.split(F.substring(F.regexp_replace(F.lower(text), "[ ，。]", ""), 1, first), ""))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def occurrences(text: Column, what: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)).cast("int")


def articles_cited(text: Column, dash: str = "-") -> Column:
    """Distinct article, paragraph or item numbers of an answer."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?:第\s*)?([0-9]+(?:[{dash}][0-9]+)?)\s*(?:條|款|項)"), F.lit(1)))


def legal(text: Column) -> Column:
    return any_of(text, lexicon.LEGAL_WORDS)


def doc_id(court: Column, case_no: Column, date: Column) -> Column:
    return F.left(F.sha2(F.concat(court, case_no, date), 256), F.lit(16))


def chunk_id(doc: Column, kind: Column, index: Column) -> Column:
    return F.format_string("%s_%s_%02d", doc, kind, index)
