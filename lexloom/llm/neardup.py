"""Operator 10, MinHash near-dedup: a chosen-path set similarity join.

A document is the set of its distinct shingles, of three words in the query and five in the pipeline (A-Z lower-cased; a
shorter document is one shingle). Two documents are linked if their Jaccard
similarity reaches the threshold, confirmed on full sets; classes are the
connected components of the links.

Steps. Documents with equal sets become one class at once. Each of some
independent trees branches the classes by minwise tokens: a node holds those
that agree in the tokens chosen on its path. Nodes start at depth START and
branch on while they hold more than SMALL classes, to depth DEPTH at most: what is
hot there are near copies of each other, and branching hardly parts them further.
A pair of similarity s shares a node of depth d with probability s**d in a
tree; there are so many trees that a pair at the threshold is missed by all with a
probability below MISSED at the greatest depth: 16 at 0.85, 22 at 0.80.

Small nodes are compared exhaustively by their classes' minwise tokens; in each only the classes
that may be linked to another of it stay, in hot nodes all, and the texts of what stays anywhere are
fetched and squeezed once.
Links are confirmed in two rounds that lose no link of a node. First each class
with the leader of its node, the class that shares most nodes with most others; this
joins large groups of near copies by as many comparisons as they have classes. Then, in nodes
whose classes are not all under one leader yet, every class with all that are under
another leader than most of the node, in blocks of SMALL by SMALL (or of SHINGLES shingles). Pairs
under one leader need no comparison: a further link would change no class.
Blocks carry texts, so a pair is compared where it meets, in one of the nodes that it shares, and only links leave the task:
first by an exact bound on set sizes, then by sketches of LONG buckets, the least shingle of each
(which a link at the threshold fails with a probability of UNLIKE at most), then by full sets.
Components spread by least labels with pointer jumping, as joins.

Defined cases: null, empty or blank text has no shingles and is linked with
nothing; rows repeated with the same id and text share everything; null ids
never become a component's id unless it has no other; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, Polynomial, U, arrow_batches, carried, keyed, mix, partitions, shared_checkpoint, signed, slices, squeezed, unsqueezed, words_of

SHINGLE = 3
PERCENT = 85
#: Of the pipeline's stage; the two above are op10's contract.
STAGE_PERCENT, STAGE_SHINGLE = 80, 5
START, DEPTH, SMALL = 2, 4, 64
MISSED, UNLIKE = 1e-5, 1e-8
#: Buckets of the longer sketch, a power of two, and the normal deviate of UNLIKE.
LONG, DEVIATE = 1024, 5.6
#: Shingles in a block at most, but for a class that has more; classes that a task keeps from batch to batch, and rows of two blocks in a batch.
SHINGLES, CLASSES, BATCH = 1 << 18, 2048, 32
#: Rows in a slice, and bits of a shingle's hash beside the row's number.
ROWS, BITS = 4095, 52
VERIFY_GROUP = 256
#: Edges for one task where only edges are moved.
EDGES = 1 << 18


@cache
def trees(percent: int) -> int:
    """So many that all miss a pair at the threshold with a probability below MISSED."""
    shared = (percent / 100) ** DEPTH
    return 1 if shared >= 1 else math.ceil(math.log(MISSED) / math.log1p(-shared))


@cache
def least_agreement(size: int, percent: int) -> int:
    """Of so many independent minwise tokens so many agree at the threshold, but for a probability of UNLIKE."""
    p = percent / 100
    if p >= 1:
        return size
    below = 0.0
    for k in range(size + 1):
        below += math.exp(math.lgamma(size + 1) - math.lgamma(k + 1) - math.lgamma(size - k + 1) + k * math.log(p) + (size - k) * math.log1p(-p))
        if below > UNLIKE:
            return k
    return size


def least_common(n: np.ndarray, m: np.ndarray, drawn: np.ndarray, percent: int) -> np.ndarray:
    """Of `drawn` shingles, a random part of the union of two sets of n and m, so many are common at the threshold, but for a probability of UNLIKE.

    They are drawn without replacement, so the deviation and the skewness shrink with the rest of the union; 1 stands for rounding.
    """
    p = percent / 100
    union = np.maximum((n + m) / (1 + p), drawn)
    rest = (union - drawn) / np.maximum(union - 1, 1)
    skew = (DEVIATE**2 - 1) / 6 * abs(1 - 2 * p) * np.maximum(union - 2 * drawn, 0) / np.maximum(union - 2, 1)
    return drawn * p - DEVIATE * np.sqrt(drawn * p * (1 - p) * rest) - skew - 1


def shingle_sets(batch: pa.RecordBatch, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of up to ROWS texts, sorted by text, and where each text's begin."""
    words = words_of(batch, fold=True)
    poly = Polynomial(words.hash)
    whole = np.flatnonzero((words.count > 0) & (words.count < size))
    at = np.flatnonzero(words.room() >= size)
    hashes = np.concatenate([poly.hashes(at, at + size), poly.hashes(words.first[whole], words.first[whole + 1])])
    doc = np.concatenate([np.searchsorted(words.first, at, "right") - 1, whole]).astype(U)
    both = np.sort((doc << U(BITS)) | (hashes >> U(64 - BITS)))
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    both = both[new]
    first = np.searchsorted(both, np.arange(len(words.count) + 1).astype(U) << U(BITS))
    return both & U((1 << BITS) - 1), first


def _sketch(size: int, percent: int):
    mins = trees(percent) * DEPTH
    seeds = np.random.default_rng(85).integers(1, 2**63, mins, dtype=np.uint64) | U(1)

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, rows=ROWS)):
            sets, first = shingle_sets(batch, size)
            n = np.diff(first)
            full = np.flatnonzero(n)
            least = np.zeros((len(n), mins), U)
            digest = np.zeros((2, len(n)), U)
            if len(full):
                spread = mix(sets)
                digest[0, full] = np.add.reduceat(spread, first[full])
                digest[1, full] = np.add.reduceat(mix(spread ^ U(0x5851F42D4C957F2D)), first[full])
                for k, seed in enumerate(seeds):
                    least[full, k] = np.minimum.reduceat(spread * seed, first[full])
            short = (mix(least) >> U(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(batch.column(k) for k in KEY), pa.array(n.astype(np.int64)), signed(digest[0]), signed(digest[1]),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * mins), pa.array(short.ravel()))],
                ["doc_id", *KEY, "n", "a", "b", "mins"],
            )

    return sketches


def _nodes(classes: DataFrame, percent: int) -> DataFrame:
    """(node, c, size): for each class and tree the node where it ends, of those that hold another class."""
    path = lambda t, depth: F.xxhash64(t, *[F.get("mins", t * DEPTH + k) for k in range(depth)])
    rows = classes.select("c", F.explode(F.transform(F.sequence(F.lit(0), F.lit(trees(percent) - 1)), lambda t: F.struct(*[path(t, d).alias(f"d{d}") for d in range(START, DEPTH + 1)]))).alias("p")).select("c", "p.*")
    out = []
    for depth in range(START, DEPTH + 1):
        node = f"d{depth}"
        sizes = rows.groupBy(node).agg(F.count("*").alias("size")).where("size > 1")
        rows = shared_checkpoint(rows.join(sizes, node))
        ends = F.lit(True) if depth == DEPTH else F.col("size") <= SMALL
        out.append(rows.where(ends).select(F.col(node).alias("node"), "c", "size"))
        rows = rows.where(~ends).drop("size", node)
    nodes = out[0]
    for x in out[1:]:
        nodes = nodes.unionByName(x)
    return nodes


def _alike(percent: int):
    """(node, c, size): the classes of small nodes that may be linked to another of their node, and how many those are."""

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
            for node, one in zip(batch.column("node").to_pylist(), batch.column("members"), strict=True):
                m = one.values
                n, mins = m.field("n").to_numpy(), m.field("mins").flatten().to_numpy().reshape(len(m), -1)
                ok = (100 * np.minimum(n[:, None], n) >= percent * np.maximum(n[:, None], n)) & ((mins[:, None] == mins).sum(-1) >= least_agreement(mins.shape[1], percent))
                np.fill_diagonal(ok, False)
                c = m.field("c").to_numpy()[ok.any(1)]
                for x, values in zip(found, (np.full(len(c), node), c, np.full(len(c), len(c))), strict=True):
                    x.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in found], ["node", "c", "size"])

    return classes


def _touched(nodes: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(node, c, size): of small nodes the classes that may be linked to another, and all of hot nodes."""
    small = nodes.where(F.col("size") <= SMALL).join(classes.select("c", "n", "mins"), "c").groupBy("node").agg(F.collect_list(F.struct("c", "n", "mins")).alias("members"))
    return small.mapInArrow(_alike(percent), "node long, c long, size long").unionByName(nodes.where(F.col("size") > SMALL).select("node", "c", "size"))


def long_sketches(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each set, and each of LONG buckets of shingles, a byte of the least in it, 0 where there is none."""
    rows = len(first) - 1
    v = mix(sets ^ U(0x2545F4914F6CDD1D))
    key = np.repeat(np.arange(rows, dtype=np.uint64), np.diff(first)) * U(LONG) + (v & U(LONG - 1))
    both = np.sort((key << U(42)) | (v >> U(22)))
    new = np.ones(len(both), bool)
    new[1:] = (both[1:] >> U(42)) != (both[:-1] >> U(42))
    out = np.zeros(rows * LONG, np.uint8)
    out[(both[new] >> U(42)).astype(np.int64)] = (mix(both[new] & U((1 << 42) - 1)) % U(255) + U(1)).astype(np.uint8)
    return out.reshape(rows, LONG)


def _blocks(nodes: DataFrame, under: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, members, strays): of each node whose classes (c, n, text) are under several leaders, every block of its classes beside every block of those outside its largest group.

    Each class brings all its nodes, by which a pair that meets in several is compared in one.
    """
    own = nodes.groupBy("c").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    mixed = nodes.select("node", "c").join(under, "c", "left").withColumn("top", F.coalesce("top", "c"))
    groups = mixed.groupBy("node", "top").agg(F.count("*").alias("n"))
    most = groups.groupBy("node").agg(F.max(F.struct("n", "top")).alias("most"), F.count("*").alias("tops")).where("tops > 1")
    most = most.select("node", F.col("most.top").alias("main"))
    mixed = mixed.join(most, "node").join(texts.join(own, "c"), "c").withColumn("stray", F.col("top") != F.col("main"))
    size = mixed.groupBy("node").agg(F.count("*").alias("m"), F.sum("n").alias("mn"), F.count_if("stray").alias("s"), F.sum(F.when(F.col("stray"), F.col("n"))).alias("sn"))
    mixed = mixed.join(size, "node")
    block = lambda count, shingles: F.pmod(F.xxhash64("c"), F.ceil(F.greatest(F.col(count) / SMALL, F.col(shingles) / SHINGLES)))
    one = F.struct("c", F.col("n").cast("long").alias("n"), "top", F.col("stray").cast("int").alias("stray"), "nodes", "text")
    members = mixed.groupBy("node", block("m", "mn").alias("block")).agg(F.collect_list(one).alias("members"))
    strays = mixed.where("stray").groupBy("node", block("s", "sn").alias("block")).agg(F.collect_list(one).alias("strays"))
    return members.drop("block").join(strays.drop("block"), "node").select("node", "members", "strays")


class _Prepared:
    """Shingle sets and sketches of the classes that a task has lately met."""

    def __init__(self, size: int):
        self.size = size
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, *columns: pa.ListArray) -> None:
        """Prepare all classes of these lists at once, each once."""
        rows = pa.concat_arrays([x.flatten() for x in columns])
        c, at = np.unique(rows.field("c").to_numpy(), return_index=True)
        if len(self.of) > CLASSES:
            self.of.clear()
        new = [k for k, one in enumerate(c.tolist()) if one not in self.of]
        batch = pa.RecordBatch.from_arrays([pa.array(c[new]), rows.field("text").take(pa.array(at[new]))], ["c", "text"])
        for part in (s for b in unsqueezed(iter([batch])) for s in slices(b, rows=ROWS)):
            sets, first = shingle_sets(part, self.size)
            sketches = long_sketches(sets, first)
            for k, one in enumerate(part.column("c").to_pylist()):
                self.of[one] = (sets[first[k] : first[k + 1]].copy(), sketches[k])


class _Block:
    """The classes of a block."""

    def __init__(self, rows: pa.StructArray, prepared: _Prepared):
        self.c, self.n, self.top, self.stray = (rows.field(k).to_numpy() for k in ("c", "n", "top", "stray"))
        self.nodes = rows.field("nodes")
        both = [prepared.of[c] for c in self.c.tolist()]
        self.sets, self.sketch = [x for x, _ in both], np.stack([x for _, x in both])
        self.none = (self.sketch == 0).astype(np.float32)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets reach the similarity."""
    both = np.sort(np.concatenate([a, b]))
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _block_links(percent: int, size: int):
    """(a, b): linked pairs of a block under different leaders, each in the least of the nodes that both are in."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = _Prepared(size)
        for batch in batches:
            if not batch.num_rows:
                continue
            prepared.add(batch.column("members"), batch.column("strays"))
            found = []
            for node, members, strays in zip(batch.column("node").to_pylist(), batch.column("members"), batch.column("strays"), strict=True):
                m, s = _Block(members.values, prepared), _Block(strays.values, prepared)
                none = s.none @ m.none.T
                sn, mn = s.n[:, None], m.n[None]
                # two strays meet twice
                ok = (100 * np.minimum(sn, mn) >= percent * np.maximum(sn, mn)) & (s.top[:, None] != m.top[None]) & ((m.stray[None] == 0) | (s.c[:, None] < m.c[None]))
                ok &= np.stack([(r == m.sketch).sum(-1) for r in s.sketch]) - none >= least_common(sn, mn, LONG - none, percent)
                for i, j in zip(*(x.tolist() for x in np.nonzero(ok)), strict=True):
                    if min(set(s.nodes[i].as_py()).intersection(m.nodes[j].as_py())) == node and _linked(s.sets[i], m.sets[j], percent):
                        found.append(sorted((int(s.c[i]), int(m.c[j]))))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return links


def _confirm(percent: int, size: int):
    """Rows sorted by group, its leader first: which of the others reach the similarity to the leader."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, np.zeros(0, U)
        for batch in (s for b in unsqueezed(batches) for s in slices(b, rows=ROWS)):
            sets, first = shingle_sets(batch, size)
            a, b = batch.column("a").to_pylist(), batch.column("c").to_pylist()
            found = []
            for i in range(batch.num_rows):
                mine = sets[first[i] : first[i + 1]]
                if a[i] == b[i]:
                    leader, own = a[i], mine
                    continue
                assert leader == a[i], "a group without its leader"
                if _linked(own, mine, percent):
                    found.append((a[i], b[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return links


def _links(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """Those pairs (a, b) of classes that are linked. A pair's first class leads a group of at most about VERIFY_GROUP."""
    groups = pairs.join(pairs.groupBy("a").agg(F.ceil(F.count("*") / VERIFY_GROUP).alias("parts")), "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part"))
    need = groups.select("a", "part", F.col("b").alias("c")).unionByName(groups.select("a", "part", F.col("a").alias("c")).distinct())
    rows = need.join(texts.select("c", "text"), "c").select("a", "part", "c", "text")
    rows = rows.repartition(partitions(pairs.sparkSession), "a", "part").sortWithinPartitions("a", "part", (F.col("a") != F.col("c")))
    return shared_checkpoint(rows.mapInArrow(_confirm(percent, size), "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(c, comp) for each end of the edges (a, b): the least end that it is connected to. Runs in as few tasks as the edges are worth."""
    tasks = 1 + edges.count() // EDGES
    both = shared_checkpoint(edges.select("a", "b").union(edges.select("b", "a")).distinct().coalesce(tasks))
    labels = shared_checkpoint(both.groupBy(F.col("a").alias("c")).agg(F.least(F.min("b"), F.first("a")).alias("comp")).coalesce(tasks))
    while True:
        near = both.join(labels, both.b == labels.c).select(F.col("a").alias("c"), "comp", F.lit(None).cast("long").alias("was")).coalesce(tasks)
        step = near.unionByName(labels.withColumn("was", F.col("comp"))).groupBy("c").agg(F.min("comp").alias("comp"), F.max("was").alias("was")).coalesce(tasks)
        jump = labels.select(F.col("c").alias("comp"), F.col("comp").alias("far"))
        step = shared_checkpoint(step.join(jump, "comp").select("c", F.least("comp", "far").alias("comp"), "was").coalesce(tasks))
        labels = step.select("c", "comp")
        if step.where("comp != was").isEmpty():
            return labels


def _tops(links: DataFrame) -> DataFrame:
    """(c, top): one of the leaders a that each b is linked to, or that one's leader."""
    tasks = 1 + links.count() // EDGES
    links = links.coalesce(tasks)
    up = links.groupBy(F.col("b").alias("c")).agg(F.min("a").alias("top")).coalesce(tasks)
    far = up.toDF("top", "far")
    up = up.join(far, "top", "left").select("c", F.coalesce("far", "top").alias("top"))
    first = links.select("a").distinct().join(up.select(F.col("c").alias("a")), "a", "left_anti")
    return shared_checkpoint(up.unionByName(first.select(F.col("a").alias("c"), F.col("a").alias("top"))).coalesce(tasks))


def _under_one(links: DataFrame, tops: DataFrame) -> DataFrame:
    """(c, comp) for each end of the links. Only links between different leaders, and of a leader to its own, need to spread; what is under a leader follows it."""
    lead = tops.toDF("a", "ta")
    edges = links.join(lead, "a", "left").join(tops.toDF("b", "tb"), "b", "left").select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b"))
    chain = tops.select(F.col("top").alias("a")).distinct().join(lead, "a").select("a", F.col("ta").alias("b"))
    comp = components(shared_checkpoint(edges.unionByName(chain).where("a != b").distinct()))
    under = tops.join(comp.toDF("top", "comp"), "top", "left").select("c", F.coalesce("comp", "top").alias("comp"))
    return under.unionByName(comp.join(tops, "c", "left_anti"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs; kept marks the one with the least id."""
    return _components_of(docs, percent, size).drop(*KEY, "group")


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """One document of each component, and all without shingles; columns as in docs."""
    found = _components_of(docs, percent, size).where("kept")
    # component_id is a document's id, which may be null or shared by unlinked texts
    stays = found.where("n_shingles > 0").groupBy("group").agg(F.min(F.struct(*KEY)).alias("k")).select("k.*").unionByName(found.where("n_shingles = 0").select(*KEY).distinct())
    return carried(docs).join(stays, KEY, "left_semi").groupBy(*KEY).agg(F.first("_row").alias("_row")).select("_row.*")


def _components_of(docs: DataFrame, percent: int, size: int) -> DataFrame:
    rows = keyed(docs)
    type_of = docs.schema["doc_id"].dataType.simpleString()
    seen = shared_checkpoint(rows.select("doc_id", *KEY, "text").mapInArrow(_sketch(size, percent), f"doc_id {type_of}, _id long, _t long, n long, a long, b long, mins array<int>"))
    equal = ["n", "a", "b"]
    classes = seen.where("n > 0").groupBy(*equal).agg(F.min("doc_id").alias("low"), F.min(F.struct(*KEY, "mins")).alias("one"))
    classes = shared_checkpoint(classes.select(F.monotonically_increasing_id().alias("c"), *equal, "low", "one.*"))

    nodes = shared_checkpoint(_touched(_nodes(classes, percent), classes, percent))
    weight = nodes.groupBy("c").agg(F.sum("size").alias("weight"))
    wanted = weight.select("c").join(classes.select("c", "n", *KEY), "c").join(squeezed(rows.select(*KEY, "text")), KEY).dropDuplicates(["c"])
    texts = shared_checkpoint(wanted.select("c", "n", "text"))

    nodes = shared_checkpoint(nodes.join(weight, "c").select("node", "c", "weight"))
    leaders = nodes.groupBy("node").agg(F.max(F.struct("weight", (-F.col("c")).alias("c"))).alias("lead")).select("node", (-F.col("lead.c")).alias("a"))
    stars = shared_checkpoint(nodes.join(leaders, "node").where("a != c").select("a", F.col("c").alias("b")).distinct())
    links = _links(stars, texts, percent, size)
    tops = _tops(links)
    with arrow_batches(docs.sparkSession, BATCH):  # a row is two blocks of texts
        links = links.unionByName(shared_checkpoint(_blocks(nodes, tops, texts).mapInArrow(_block_links(percent, size), "a long, b long")))
    comp = _under_one(links, tops)

    lows = comp.join(classes.select("c", "low"), "c")
    lows = lows.join(lows.groupBy("comp").agg(F.min("low").alias("least")), "comp").select("c", "least", "comp")
    named = classes.join(lows, "c", "left").select(*equal, F.coalesce("least", "low").alias("least"), F.coalesce("comp", "c").alias("group"))
    out = seen.select("doc_id", *KEY, *equal).join(named, equal, "left")
    out = out.select("doc_id", *KEY, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), "group")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
