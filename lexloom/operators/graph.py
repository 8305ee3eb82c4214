"""Typed property graphs as node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIERARCHY = ("is_a", "has_part")


def relations(edges: DataFrame, kind: str | None = None) -> DataFrame:
    """(id, other, type, direction): all out-edges, and one in-edge per source that is not a target already; for all ids at once."""
    e = edges if kind is None else edges.where(F.col("type") == kind)
    out = e.select(F.col("src").alias("id"), F.col("dst").alias("other"), "type", F.lit("out").alias("direction"))
    w = Window.partitionBy("id", "other").orderBy("type")
    back = e.where("src != dst").select(F.col("dst").alias("id"), F.col("src").alias("other"), "type", F.lit("in").alias("direction"))
    return out.unionByName(back.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn"))


def neighbours(edges: DataFrame, up: bool, kinds=HIERARCHY) -> DataFrame:
    """(id, other): one hop over the given kinds, against the edges if up."""
    e = edges.where(F.col("type").isin(*kinds))
    return e.select(F.col("dst" if up else "src").alias("id"), F.col("src" if up else "dst").alias("other"))


def reach(edges: DataFrame, starts: DataFrame, depth: int, up: bool) -> DataFrame:
    """(start, id, depth): everything within `depth` hops of starts(id), each once at its least depth. From the second hop on each front is checkpointed, so the plan does not grow with the depth."""
    from lexloom.sources.shared import checkpoint

    hops = neighbours(edges, up).distinct()
    seen = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth"))
    if depth > 1:
        hops, seen = checkpoint(hops), checkpoint(seen)
    front = seen
    for d in range(1, depth + 1):
        front = front.join(hops, "id").select("start", F.col("other").alias("id"), F.lit(d).alias("depth")).distinct()
        front = front.join(seen.select("start", "id"), ["start", "id"], "left_anti")
        front = checkpoint(front) if d < depth else front
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def shortest_paths(edges: DataFrame, starts: DataFrame, depth: int, targets: DataFrame | None = None) -> DataFrame:
    """(start, id, depth, path): one shortest path from each of starts(id) to each entity (of targets, if given) within `depth` hops, over edges(src, dst) in either direction.

    Breadth first: each entity is met once for each start, and keeps the one before it, the least id of those at that depth; paths are put
    together from these afterwards, from the ends back, so fronts carry two ids only. Each front is checkpointed.
    """
    from lexloom.sources.shared import checkpoint

    both = edges.where("src != dst").select(F.col("src").alias("before"), F.col("dst").alias("id"))
    both = checkpoint(both.union(both.select("id", "before")).distinct())
    front = checkpoint(starts.select(F.col("id").alias("start"), "id").distinct())
    met = [front.withColumn("before", F.lit(None).cast(front.schema["id"].dataType))]
    seen = front
    for _ in range(depth):
        front = seen_front(front, both).join(seen, ["start", "id"], "left_anti")
        front = checkpoint(front)
        if front.isEmpty():
            break
        met.append(front)
        seen = seen.unionByName(front.select("start", "id"))
        front = front.select("start", "id")
    out = None
    for d in range(1, len(met)):
        rows = met[d] if targets is None else met[d].join(targets.select("id").distinct(), "id", "left_semi")
        rows = rows.select("start", "id", "before", F.array("before", "id").alias("path"))
        for back in range(d - 1, 0, -1):
            step = met[back].select("start", F.col("id").alias("before"), F.col("before").alias("further"))
            rows = rows.join(step, ["start", "before"]).select("start", "id", F.col("further").alias("before"), F.concat(F.array("further"), "path").alias("path"))
        rows = rows.select("start", "id", F.lit(d).alias("depth"), "path")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else met[0].select("start", "id", F.lit(0).alias("depth"), F.array("id").alias("path")).limit(0)


def seen_front(front: DataFrame, both: DataFrame) -> DataFrame:
    """(start, id, before): the next hop of a front(start, id), each with the least one before."""
    step = both.select(F.col("before").alias("_at"), F.col("id").alias("_next"))
    return front.join(step, F.col("id") == F.col("_at")).groupBy("start", F.col("_next").alias("id")).agg(F.min("_at").alias("before"))


def context(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int = 2, lists: tuple[str, ...] = ("above", "below", "refs")) -> DataFrame:
    """Per start the labels above, below, referenced, and its path: above, itself, below.

    lists: which of these are wanted as lists, for starts that have a few; of the others there is only the number of labels, n_above, n_below or n_refs.
    """
    label = nodes.select(F.col("id"), "label")

    def listed(rows: DataFrame, name: str) -> DataFrame:
        labels = rows.join(label, "id").groupBy("start")
        return labels.agg(F.array_sort(F.collect_set("label")).alias(name)) if name in lists else labels.agg(F.count_distinct("label").alias(f"n_{name}"))

    refs = edges.where(F.col("type").isin("references", "see_also")).select(F.col("src").alias("start"), F.col("dst").alias("id"))
    out = starts.join(label, "id").select(F.col("id").alias("start"), "label")
    for rows, name in ((reach(edges, starts, depth, True), "above"), (reach(edges, starts, depth, False), "below"), (refs, "refs")):
        out = out.join(listed(rows, name), "start", "left")
        out = out.withColumn(name, F.coalesce(name, F.array().cast("array<string>"))) if name in lists else out.withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    return out.withColumn("path", F.array_join(F.concat("above", F.array("label"), "below"), " → ")) if {"above", "below"} <= set(lists) else out


#: Prefixes of the ids of entities made from tables.
PREFIXES = {"Article": "art-", "Concept": "con-"}


def entities(rows: DataFrame, kind: str, key: Column, label: Column, text: Column) -> DataFrame:
    """(id, label, type, metadata) of articles or concepts."""
    return rows.select(F.concat(F.lit(PREFIXES[kind]), key.cast("string")).alias("id"), label.alias("label"), F.lit(kind).alias("type"), F.create_map(F.lit("text"), text).alias("metadata"))


def entity_json() -> Column:
    return F.to_json(F.struct("id", "label", "type", "metadata"))


def entities_of_json(rows: DataFrame, column: str) -> DataFrame:
    """Entities back from their JSON; without metadata it is empty."""
    x = F.from_json(column, "id string, label string, type string, metadata map<string,string>")
    return rows.select(x.alias("x")).select("x.id", "x.label", "x.type", F.coalesce("x.metadata", F.create_map().cast("map<string,string>")).alias("metadata"))


def retrieve(queries: DataFrame, points: DataFrame, nodes: DataFrame, edges: DataFrame, k: int, depth: int = 2, lists: tuple[str, ...] = ("above", "below", "refs")) -> DataFrame:
    """The k nearest points(id, v, entity) of each of queries(query_id, q), each with the surroundings of its entity, null where the graph has none; surroundings are found for the entities that were met only."""
    from lexloom.operators import retrieval
    from lexloom.sources.shared import checkpoint

    found = retrieval.top_k(queries, points.select("id", "v"), k).join(points.select("id", "entity"), "id")
    found = checkpoint(found.select("query_id", "id", "score", "rank", "entity"))
    around = context(nodes, edges, found.select(F.col("entity").alias("id")).distinct(), depth, lists)
    return found.join(around, F.col("entity") == F.col("start"), "left").drop("start")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ids = nodes.select("id")
    return edges.join(ids, F.col("src") == F.col("id"), "left_anti").unionByName(edges.join(ids, F.col("dst") == F.col("id"), "left_anti")).distinct()
