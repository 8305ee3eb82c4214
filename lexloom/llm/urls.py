"""Operator 1, URL filters: a path-template tree beside domain rules.

Rules come first: a rule fits its host and all subdomains if the path starts
with the rule's path; the longest rule wins. Urls that a rule judges are the
labelled ones. All others are judged by their templates.

The tree. A path is cut at its slashes. Below each host, and level by level, a
segment stays as it is if it is frequent among its siblings (SHARE of the
parent's urls and MIN_COUNT urls) and otherwise becomes the wildcard of its shape: digits,
hex, words, or mixed, with its extension. Siblings without labels take part in a
wildcard only if MIN_LABELS labelled siblings of the shape, with COVER of its urls
labelled, speak for them; else they are a wildcard of their own, marked "?". A labelled branch of a wildcard
shape is merged with its siblings of that shape if a chi-square test on its labels and theirs does not tell them apart (below
MERGE); those that it tells apart form the two groups above and below their siblings' rate. A
template is rejected if it has MIN_LABELS labelled urls of its own and their smoothed share
of blocked ones in its branch, (blocked + PRIOR * rate) / (labelled + PRIOR), is at least
REJECT; the rate is that of the parent, and even above the host. Urls that end at an inner node have only each other's labels.

Levels are rounds, and only urls that a further level can still change take part in one. A url that has ended is put aside. So are all
urls of a branch without any label, which are allowed whatever stands below; their template ends with "**". A path that is alone in its
branch is finished at once, as its further segments have no siblings. So a path of a thousand segments costs no more than
one of ten, unless labelled paths share as many.

Each level is a partial aggregate and an equi-join on (node, segment), whose sides Spark can split where a host is hot. Only counts are exchanged, urls once, by their hash.

Defined cases: a null url, or one without ://, has an empty host and path, fits no rule and is
allowed; repeated urls count each; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_checkpoint

#: The rules (host, path) with their verdicts.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
SHARE, MIN_COUNT = 0.02, 20
MERGE, PRIOR, REJECT, MIN_LABELS, COVER = 3.84, 4.0, 0.7, 5, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict by the longest fitting rule; null where none fits."""
    rows = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rows.withColumn("rule", rule).withColumn("verdict", verdict)


def _shape(s: Column) -> Column:
    """The wildcard for a segment."""
    stem, ext = F.regexp_extract(s, r"^(.*?)(\.[A-Za-z]{1,5})?$", 1), F.regexp_extract(s, r"^(.*?)(\.[A-Za-z]{1,5})?$", 2)
    kind = F.when(stem == "", "").when(stem.rlike(r"^[0-9]+$"), "{n}").when(stem.rlike(r"^[0-9a-fA-F]{8,}$"), "{hex}").when(stem.rlike(r"^[^0-9]+$"), "{word}").otherwise("{mix}")
    return F.concat(kind, ext)


def _smooth(blocked: Column, labelled: Column, rate: Column) -> Column:
    return (blocked + PRIOR * rate) / (labelled + PRIOR)


def _rated(rows: DataFrame, keys: list[str], rate: str) -> DataFrame:
    """Counts of urls, labels and blocks by keys, with the smoothed purity against the parent's."""
    sums = rows.groupBy(*keys).agg(F.count("*").alias("members"), F.sum("n").alias("all"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.first(rate).alias("up"))
    return sums.withColumn("purity", _smooth(F.col("b"), F.col("l"), F.col("up")))


def _joined(rows: DataFrame, sums: DataFrame, key: str) -> DataFrame:
    """rows with the sums of their key. Sums are dealt once more for the join: as they come from their aggregate, Spark could not split a hot key's rows."""
    k = F.xxhash64(key, F.lit("join"))
    return rows.withColumn("_k", k).join(sums.withColumn("_k", k), ["_k", key]).drop("_k")


def _finished(rows: DataFrame, level: int) -> DataFrame:
    """Rows that leave the tree at this level, with the node and purity of their last: those with segments left are alone in their branch, or no label is in it."""
    rest = F.slice("segments", level + 1, F.greatest(F.size("segments") - level, F.lit(0)))
    tail = F.transform(rest, lambda s: F.when(F.col("n") >= MIN_COUNT, s).otherwise(_shape(s)))
    quiet = F.col("told") == 0
    last = F.aggregate(rest, F.col("purity"), lambda rate, _: _smooth(F.col("blocked"), F.col("labelled"), rate))
    node = F.when(F.size(rest) == 0, F.col("node")).when(quiet, F.concat("node", F.lit("/**"))).otherwise(F.concat_ws("/", "node", tail))
    return rows.select("host", "path", node.alias("node"), F.when(quiet, F.col("purity")).otherwise(last).alias("purity"), "labelled")


def templates(judged: DataFrame) -> DataFrame:
    """(host, path, template, purity, labels) for each distinct host and path of judged urls."""
    rows = judged.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("verdict").alias("labelled"), F.count_if(F.col("verdict") == "block").alias("blocked"))
    rows = rows.withColumn("segments", F.expr("slice(split(path, '/'), 2, greatest(size(split(path, '/')) - 1, 0))")).withColumn("purity", F.lit(0.5))
    hosts = _rated(rows, ["host"], "purity").select("host", F.col("purity").alias("next"), F.col("l").alias("told"), "members")
    rows = _joined(rows, hosts, "host").drop("purity").withColumnRenamed("next", "purity").withColumn("node", F.col("host"))
    done = []
    for level in count():
        rows = shared_checkpoint(rows.withColumn("segment", F.get("segments", F.lit(level))))
        ended, quiet, single = F.col("segment").isNull(), F.col("told") == 0, F.col("members") == 1
        done.append(_finished(rows.where(ended | quiet | single), level))
        going = rows.where(~(ended | quiet | single))
        if going.isEmpty():
            break
        # what stays literal, what becomes a wildcard
        parent = going.groupBy("node").agg(F.sum("n").alias("total"))
        child = _rated(going, ["node", "segment"], "purity").join(parent, "node")
        stays = (F.col("all") >= MIN_COUNT) & (F.col("all") >= SHARE * F.col("total"))
        # labels speak for siblings without any only if enough siblings and urls of the shape have them
        child = child.withColumn("shape", F.when(~stays, _shape(F.col("segment"))))
        shapes = child.where("shape is not null").groupBy("node", "shape").agg(F.count_if(F.col("l") > 0).alias("told"), F.sum("l").alias("sl"), F.sum("b").alias("sb"), F.sum("all").alias("sall"))
        child = child.join(shapes, ["node", "shape"], "left")
        speaks = (F.col("told") >= MIN_LABELS) & (F.col("sl") >= COVER * F.col("sall"))
        alone = (F.col("l") == 0) & (F.col("sl") > 0) & ~speaks
        # a wildcard branch that the test tells apart from its siblings of the shape goes to their upper or lower group
        rest, blocked = F.col("sl") - F.col("l"), F.col("sb") - F.col("b")
        rate = F.col("sb") / F.greatest(F.col("sl"), F.lit(1))
        gap = F.col("b") / F.greatest(F.col("l"), F.lit(1)) - blocked / F.greatest(rest, F.lit(1))
        chi = gap * gap / F.greatest(rate * (1 - rate) * (1 / F.greatest(F.col("l"), F.lit(1)) + 1 / F.greatest(rest, F.lit(1))), F.lit(1e-9))
        side = F.when(alone, "?").when((F.col("l") == 0) | (rest == 0) | (chi < MERGE), "").when(gap > 0, "+").otherwise("-")
        child = child.withColumn("part", F.when(stays, F.col("segment")).otherwise(F.concat("shape", side)))
        merged = child.groupBy("node", "part").agg(F.sum("b").alias("mb"), F.sum("l").alias("told"), F.first("up").alias("mup"), F.sum("members").alias("members"))
        child = child.select("node", "segment", "part").join(merged, ["node", "part"]).select("node", "segment", "part", "told", "members", _smooth(F.col("mb"), F.col("told"), F.col("mup")).alias("next"))
        rows = going.drop("told", "members").join(child, ["node", "segment"])
        rows = rows.withColumn("purity", F.col("next")).withColumn("node", F.concat_ws("/", "node", "part")).drop("next", "part")
    rows = done[0]
    for x in done[1:]:
        rows = rows.unionByName(x)
    own = rows.groupBy("node").agg(F.sum("labelled").alias("labels"))
    rows = _joined(rows, own, "node")
    return rows.select("host", "path", F.col("node").alias("template"), F.round("purity", 9).alias("purity"), "labels")


def filter_urls(pages: DataFrame, rules=RULES, reject: float = REJECT) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity for each row of pages."""
    judged = ruled(pages, rules)
    named = judged.where("host != '' or path != ''")
    out = judged.join(templates(named), ["host", "path"], "left")
    method = F.when((F.col("purity") >= reject) & (F.col("labels") >= MIN_LABELS), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), "template", "purity")
