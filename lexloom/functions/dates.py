"""Calendar and numeral expressions: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The numerals and units of Chinese numbers.
_DIGITS = {"〇": 0, "零": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "兩": 2}
_UNITS = {"十": 10, "百": 100, "千": 1000}


def chinese_number(text: Column) -> Column:
    """The value of a Chinese numeral with units; of digits side by side the last counts; other characters are skipped."""
    units = F.create_map(*[F.lit(x) for kv in _UNITS.items() for x in kv])
    digits = F.create_map(*[F.lit(x) for kv in _DIGITS.items() for x in kv])

    def step(state: Column, c: Column) -> Column:
        unit, digit = units[c], digits[c]
        grown = state["total"] + F.when(state["digit"] == 0, 1).otherwise(state["digit"]) * unit
        total = F.when(unit.isNotNull(), grown).otherwise(state["total"])
        last = F.when(unit.isNotNull(), F.lit(0)).when(digit.isNotNull(), digit).otherwise(state["digit"])
        return F.struct(total.alias("total"), last.alias("digit"))

    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("digit"))
    return F.aggregate(F.split(text, ""), start, step, lambda s: s["total"] + s["digit"])


def arabic_or_chinese(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("int")).otherwise(chinese_number(text))


def roc_date(text: Column) -> Column:
    """YYYYMMDD of the first year, month and day of the Republic's calendar in a text; empty if there is none."""
    number = "([0-9〇零一二三四五六七八九兩十百千]+)"
    triple = rf"{number}\s*年\s*{number}\s*月\s*{number}\s*日"
    year, month, day = (arabic_or_chinese(F.regexp_extract(text, triple, k)) for k in (1, 2, 3))
    whole = (year > 0) & (month > 0) & (day > 0)
    return F.when(whole, F.concat(F.lpad((year + 1911).cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))).otherwise("")


def amendment_dates(text: Column) -> Column:
    """All distinct dates of an amendment history, ascending."""
    found = F.transform(F.regexp_extract_all(text, F.lit("(中華民國[^日]*日)"), F.lit(1)), roc_date)
    return F.array_sort(F.array_distinct(F.filter(found, lambda d: d != "")))


def ymd(text: Column) -> Column:
    """A date's eight digits if they are a real date, else empty."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    good = (F.length(digits) == 8) & F.try_to_date(digits, "yyyyMMdd").isNotNull()
    return F.when(good, digits).otherwise("")


def add_days(text: Column, days: int | Column) -> Column:
    date = F.try_to_date(ymd(text), "yyyyMMdd")
    return F.coalesce(F.date_format(F.date_add(date, days), "yyyyMMdd"), F.lit(""))


def dashed(text: Column) -> Column:
    """Eight characters with dashes; anything else as it is."""
    return F.when(F.length(text) == 8, F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))).otherwise(text)


def roc_slashes(text: Column) -> Column:
    """114/01/01 as a date; null if it is none."""
    part = lambda k: F.try_element_at(F.split(text, "/"), F.lit(k)).try_cast("int")
    return F.try_to_date(F.format_string("%04d-%02d-%02d", part(1) + 1911, part(2), part(3)))
