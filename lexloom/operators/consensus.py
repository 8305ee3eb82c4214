"""Several reviewers' answers: claims, clusters, disagreements, blind spots, components, dispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import citation
from lexloom.functions import text as T


def claims(responses: DataFrame) -> DataFrame:
    """responses(query_id, model, text): a claim for each article cited, or one general claim without status."""
    rows = responses.withColumn("refs", citation.cited_articles(F.col("text"))).withColumn("s", citation.status(F.col("text")))
    rows = rows.select("query_id", "model", "s", F.posexplode_outer("refs").alias("pos", "ref"))
    return rows.select(
        "query_id", "model", F.coalesce("pos", F.lit(0)).alias("pos"),
        F.when(F.col("ref").isNull(), "general").otherwise(F.concat(F.lit("民法第"), F.col("ref"), F.lit("條"))).alias("article_ref"),
        F.when(F.col("ref").isNotNull(), F.col("s.status")).alias("status"),
    )


def response_layers(text: Column) -> Column:
    """(state, citations, claim_status): error or agree; the text with its citations in one form; its status in one word."""
    status = citation.status(text)["status"]
    return F.struct(
        F.when(F.coalesce(status, F.lit("")) == "error", "error").otherwise("agree").alias("state"),
        citation.normalize(text).alias("citations"),
        F.coalesce(status, F.lit("unknown")).alias("claim_status"),
    )


def clusters(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows(key…, model, status) grouped by key: who, which statuses, and whether they agree."""
    grouped = rows.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"), F.array_join(F.array_sort(F.collect_set("status")), ",").alias("statuses"), F.count_distinct("status").alias("n_statuses"), F.count("*").alias("n_claims"))
    return grouped.withColumn("label", F.when(F.col("n_statuses") <= 1, "consensus").otherwise("disagreement"))


def disagreements(rows: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of models of a cluster with different positions; positions are grouped first, so equal claims make no pairs."""
    held = rows.where("status is not null").groupBy(*key, "model", "status").agg(F.count("*").alias("n"))
    a, b = held.select(*key, F.col("model").alias("model_a"), F.col("status").alias("position_a")), held.select(*key, F.col("model").alias("model_b"), F.col("status").alias("position_b"))
    return a.join(b, key).where("model_a < model_b and position_a != position_b")


def blind_spots(rows: DataFrame, key: list[str], statuses=("nonexistent", "deleted"), least: int = 2) -> DataFrame:
    """References that at least `least` models call invalid."""
    return rows.where(F.col("status").isin(*statuses)).groupBy(*key).agg(F.count_distinct("model").alias("models")).where(F.col("models") >= least)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each end of the edges(a, b): the least id reachable.

    Least labels with pointer jumping over the ends of edges only; every round is two joins, its result is
    checkpointed in the shared folder, and rounds stop when no label changes.
    """
    from lexloom.sources.shared import checkpoint

    both = checkpoint(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = checkpoint(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).select(F.col("a").alias("id"), "component", F.lit(None).cast(labels.schema["component"].dataType).alias("was"))
        step = near.unionByName(labels.withColumn("was", F.col("component"))).groupBy("id").agg(F.min("component").alias("component"), F.max("was").alias("was"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("far"))
        step = checkpoint(step.join(jump, "component").select("id", F.least("component", "far").alias("component"), "was"))
        labels = step.select("id", "component")
        if step.where("component != was").isEmpty():
            return labels


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) for each node: the least id reachable; edges(a, b) between nodes in either direction. Nodes without edges take no part in the rounds."""
    found = components(edges)
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


#: Claims of a dimension up to which they are compared where they stand.
SMALL = 64


def similar_claims(rows: DataFrame, threshold: float = 0.35, small: int = SMALL) -> DataFrame:
    """Pairs (a, b) of claims(id, dimension, issue) of one dimension whose beginnings share their characters.

    Of a small dimension all claims meet in one row, so its texts travel once. Of a larger one a claim is looked for by its rarest
    characters only, so many that any claim above the threshold
    shares one of them, and among claims of a fitting number of characters; a common
    character alone brings no pairs. The similarity of what meets is exact.
    """
    from lexloom.sources.shared import checkpoint

    rows = rows.where("dimension IS NOT NULL AND id IS NOT NULL").select("id", "dimension", "issue")
    large = checkpoint(rows.groupBy("dimension").agg(F.count("*").alias("n")).where(F.col("n") > small).select("dimension"))
    if large.isEmpty():
        return _where_they_stand(rows, threshold)
    some, rest = rows.join(large, "dimension", "left_anti"), rows.join(large, "dimension", "left_semi")
    return _where_they_stand(some, threshold).unionByName(_by_rare_characters(rest, threshold))


def _sets(rows: DataFrame) -> DataFrame:
    chars = rows.select("id", "dimension", T.characters(F.col("issue")).alias("chars"))
    return chars.withColumn("chars", F.filter("chars", lambda c: c != ""))


def _where_they_stand(rows: DataFrame, threshold: float) -> DataFrame:
    """One exchange, of the texts; sets are made behind it, once a claim."""
    met = rows.groupBy("dimension").agg(F.collect_set(F.struct("id", "issue")).alias("claims"))
    own = F.transform("claims", lambda x: F.struct(x["id"].alias("id"), F.filter(T.characters(x["issue"]), lambda c: c != "").alias("chars")))
    met = met.select(own.alias("claims")).select("claims", F.explode("claims").alias("x"))
    pairs = met.select(F.col("x.id").alias("a"), F.col("x.chars").alias("chars"), F.explode("claims").alias("y")).where(F.col("a") < F.col("y.id"))
    return pairs.where(T.jaccard(F.col("chars"), F.col("y.chars")) > threshold).select("a", F.col("y.id").alias("b"))


def _by_rare_characters(rows: DataFrame, threshold: float) -> DataFrame:
    each = _sets(rows).select("id", "dimension", "chars", F.explode("chars").alias("c"))
    often = each.groupBy("dimension", "c").agg(F.count("*").alias("often"))
    n = F.size("chars")
    first = F.slice(F.array_sort(F.collect_list(F.struct("often", "c"))), 1, F.max(n - F.ceil(threshold * n).cast("int") + 1))
    keys = each.join(often, ["dimension", "c"]).groupBy("dimension", "id").agg(F.any_value("chars").alias("chars"), first.alias("first"))
    keys = keys.select("dimension", "id", "chars", F.explode("first.c").alias("c"))
    met = keys.join(keys.toDF("dimension", "id_b", "chars_b", "c"), ["dimension", "c"]).where("id < id_b")
    met = met.where((F.size("chars_b") >= threshold * F.size("chars")) & (F.size("chars") >= threshold * F.size("chars_b")))
    return met.where(T.jaccard(F.col("chars"), F.col("chars_b")) > threshold).select(F.col("id").alias("a"), F.col("id_b").alias("b")).distinct()


# What a cluster's label leads to, by priority.
ACTIONS = (("blind_spot", "human_review", 0), ("consensus", "auto_fix", 1), ("unique_insight", "verify_apply", 2), ("disagreement", "user_choice", 3))
SEVERITIES = ("minor", "major", "critical")


def action(label: Column) -> Column:
    out = None
    for name, what, priority in ACTIONS:
        value = F.struct(F.lit(what).alias("action"), F.lit(priority).alias("priority"))
        out = F.when(label == name, value) if out is None else out.when(label == name, value)
    return out


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def verdict(valid: Column, shared: Column) -> Column:
    """Of several providers' answers: none valid, one, or a long enough common passage."""
    return F.when(valid == 0, "blind_spot").when(valid == 1, "dissensus").when(F.length(shared) > 50, "consensus").otherwise("dissensus")


def confidence(number: Column, text: Column) -> Column:
    """A claim's confidence: numbers clamped to 0..1, texts as percentages, 0.8 by default."""
    percent = F.regexp_replace(text, "%", "").try_cast("double") / 100
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, percent))), F.lit(0.8))
