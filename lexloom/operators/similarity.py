"""Claims whose beginnings share their characters, at any threshold and for dimensions of any size.

At a low threshold nearly all claims of a dimension are alike, so pairs are never made: claims of one dimension
with equal character sets are one class, and classes are compared block by block as 0/1 rows over the characters
that both blocks have (one matrix product gives all common characters). A block pair leaves one row for each of its classes: how many claims it is linked
to there, and the least class of its part of the block pair, which is as good as its links for finding components.

Blocks: a dimension of more than BLOCK / 4 classes is cut by the size of the sets and then by hash into blocks of about BLOCK; two blocks meet only if their sizes
can reach the threshold. Smaller dimensions share blocks, where each class meets those of its own dimension only, and its least class is already that of its
component. So a hot dimension is many tasks, many small ones are few, and only large ones take part in the rounds that find components.

Defined cases: null or empty texts have no set and are linked with nothing; repeated claims are linked with each
other; a null dimension is a dimension; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators.consensus import components
from lexloom.sources.shared import checkpoint

BLOCK = 2048
THRESHOLD = 0.35


def classes(rows: DataFrame) -> DataFrame:
    """(c, dimension, chars, size, n, least): a row for each dimension and character set of claims(id, dimension, issue)."""
    sets = rows.select("id", "dimension", F.array_sort(F.filter(T.characters(F.col("issue")), lambda c: c != "")).alias("chars")).where(F.size("chars") > 0)
    one = sets.groupBy("dimension", "chars").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    return checkpoint(one.select(F.monotonically_increasing_id().alias("c"), "dimension", "chars", F.size("chars").alias("size"), "n", "least"))


def _blocks(found: DataFrame, block: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Classes with their block (group, part, size), and the pairs of blocks that may hold links."""
    per = found.groupBy("dimension").agg(F.count("*").alias("all"))
    small = per.where(F.col("all") <= block // 4)
    packs = small.agg(F.coalesce(F.sum("all"), F.lit(0)).alias("n")).select(F.greatest(F.lit(1), F.ceil(F.col("n") / (block // 2))).alias("packs"))
    key = F.xxhash64(F.col("dimension").cast("string"), F.col("dimension").isNull())
    same = F.col("l.dimension").eqNullSafe(F.col("r.dimension"))
    grouped = found.alias("l").join(per.alias("r"), same).select("l.*", F.col("r.all").alias("all")).join(F.broadcast(packs))
    is_small = F.col("all") <= block // 4
    grouped = grouped.withColumn("group", F.when(is_small, F.pmod(key, "packs")).otherwise(key)).withColumn("large", ~is_small).withColumn("at", F.when(is_small, 0).otherwise(F.col("size")))
    count = grouped.where("large").groupBy("group", "at").agg(F.ceil(F.count("*") / block).alias("cuts"))
    grouped = grouped.join(count, ["group", "at"], "left").withColumn("part", F.when(F.col("large"), F.pmod(F.xxhash64("c"), "cuts")).otherwise(F.lit(0)))
    grouped = checkpoint(grouped.select("c", "chars", "n", F.xxhash64("dimension", "large").alias("own"), "large", "group", "at", "part"))
    have = grouped.groupBy("large", "group", "at", "part").agg(F.count("*").alias("rows"))
    a, b = have.drop("rows"), have.drop("rows").select("large", "group", F.col("at").alias("at_b"), F.col("part").alias("part_b"))
    met = a.join(b, ["large", "group"]).where("struct(at, part) <= struct(at_b, part_b)").where(F.col("at") >= threshold * F.col("at_b"))
    return grouped, met


def _tile(threshold: float):
    """Of two blocks: for each class with a link how many claims it is linked to, and the least class that it is connected with."""

    def rows_of(table: pa.Table) -> tuple:
        lists = table.column("chars").combine_chunks()
        return table.column("c").to_numpy(), table.column("n").to_numpy().astype(np.float64), table.column("own").to_numpy(), lists.value_lengths().to_numpy(), np.array(lists.flatten().to_pylist())

    def linked(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (len(left) and len(right)):
            return pa.table({"c": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "least": pa.array([], pa.int64())})
        (c, n, own, size, chars), (d, m, other, more, letters) = rows_of(left), rows_of(right)
        both = np.intersect1d(chars, letters)

        def incidence(sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
            at = np.searchsorted(both, values)
            ok = (at < len(both)) & (both[np.minimum(at, len(both) - 1)] == values)
            out = np.zeros((len(sizes), len(both)), np.float32)
            out[np.repeat(np.arange(len(sizes)), sizes)[ok], at[ok]] = 1
            return out

        common = incidence(size, chars) @ incidence(more, letters).T if len(both) else np.zeros((len(c), len(d)), np.float32)
        alike = common.astype(np.float64) / (size[:, None] + more[None] - common) > threshold
        alike &= (own[:, None] == other[None]) & (c[:, None] != d[None])
        whole = left.column("pair")[0].as_py()  # a block beside itself: each link stands twice
        links = (alike @ m, np.zeros(len(d)) if whole else n @ alike)
        up, down = c.copy(), d.copy()
        while True:  # least labels
            new = np.minimum(up, np.where(alike, down[None], np.iinfo(np.int64).max).min(1))
            far = np.minimum(down, np.where(alike, new[:, None], np.iinfo(np.int64).max).min(0))
            if (new == up).all() and (far == down).all():
                break
            up, down = new, far
        some, rest = alike.any(1), alike.any(0) & (not whole)
        return pa.table({"c": np.concatenate([c[some], d[rest]]), "links": np.concatenate([links[0][some], links[1][rest]]).astype(np.int64), "least": np.concatenate([up[some], down[rest]])})

    return linked


def _by_dimension(threshold: float):
    """Of a block of whole small dimensions: the same as _tile, by comparing rows that lie side by side, two apart and so on while they are of one dimension; `least` is that of the component."""

    def linked(rows: pa.Table) -> pa.Table:
        lists = rows.column("chars").combine_chunks()
        size, values = lists.value_lengths().to_numpy(), np.array(lists.flatten().to_pylist())
        order = np.argsort(rows.column("own").to_numpy(), kind="stable")
        c, n, own = (rows.column(x).to_numpy()[order] for x in ("c", "n", "own"))
        letters, at = np.unique(values, return_inverse=True)
        has = np.zeros((len(c), len(letters)), bool)
        has[np.repeat(np.arange(len(c)), size), at] = True
        has, size = has[order], size[order]
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for apart in range(1, len(c)):
            first = np.flatnonzero(own[:-apart] == own[apart:])
            if not len(first):
                break
            common = np.count_nonzero(has[first] & has[first + apart], axis=1).astype(np.float64)
            first = first[common / (size[first] + size[first + apart] - common) > threshold]
            u.append(first)
            v.append(first + apart)
        a, b = np.concatenate(u), np.concatenate(v)
        links, least = np.zeros(len(c), np.int64), c.copy()
        np.add.at(links, a, n[b])
        np.add.at(links, b, n[a])
        while len(a):
            low = np.minimum(least[a], least[b])
            if (least[a] == low).all() and (least[b] == low).all():
                break
            np.minimum.at(least, a, low)
            np.minimum.at(least, b, low)
        some = links > 0
        return pa.table({"c": c[some], "links": links[some], "least": least[some]})

    return linked


def linked_classes(found: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(c, links, least, whole): for each block pair and class that is linked there, the number of claims and the least class; whole where this is the component's."""
    grouped, met = _blocks(found, block, threshold)
    schema = "c long, links long, least long"
    near = grouped.where("NOT large").select("group", "c", "chars", "n", "own").groupBy("group").applyInArrow(_by_dimension(threshold), schema)
    place = ["group", "at", "part", "at_b", "part_b"]
    grouped, met = grouped.where("large"), met.where("large")
    pair = (F.col("at") == F.col("at_b")) & (F.col("part") == F.col("part_b"))
    left = grouped.join(met.drop("large"), ["group", "at", "part"]).select(*place, "c", "chars", "n", "own", pair.alias("pair"))
    right = grouped.withColumnsRenamed({"at": "at_b", "part": "part_b"}).join(met.drop("large"), ["group", "at_b", "part_b"]).select(*[F.col(x).alias(x) for x in (*place, "c", "chars", "n", "own")])
    far = left.groupBy(*place).cogroup(right.groupBy(*place)).applyInArrow(_tile(threshold), schema)
    return checkpoint(near.withColumn("whole", F.lit(True)).unionByName(far.withColumn("whole", F.lit(False))))


def similar(rows: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(dimension, chars, n, least, links, component): each class of claims(id, dimension, issue), how many claims each of its claims is linked to, and the least claim that these reach."""
    found = classes(rows)
    links = linked_classes(found, threshold, block)
    comp = links.where("whole").select("c", F.col("least").alias("comp"))
    far = checkpoint(links.where("NOT whole AND c != least").select(F.col("c").alias("a"), F.col("least").alias("b")).distinct())
    if not far.isEmpty():
        comp = comp.unionByName(components(far).toDF("c", "comp"))
    out = found.join(links.groupBy("c").agg(F.sum("links").alias("links")), "c", "left").join(comp, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    first = out.groupBy("comp").agg(F.min("least").alias("component"))
    return out.join(first, "comp").select("dimension", "chars", "n", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component")


def of_claims(rows: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(id, links, component) for each of claims(id, dimension, issue); a claim without a set has no links and is its own component."""
    found = similar(rows, threshold, block).select(F.col("dimension").alias("_d"), "chars", "links", "component")
    sets = rows.select("id", "dimension", F.array_sort(F.filter(T.characters(F.col("issue")), lambda c: c != "")).alias("_chars"))
    out = sets.join(found, F.col("dimension").eqNullSafe(F.col("_d")) & (F.col("_chars") == F.col("chars")), "left")
    return out.select("id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component"))
