"""Stored tables, the vector index, similar claims and the tracking stream, beyond what the oracles show."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import retrieval, similarity, vector_index
from lexloom.sources.stored import Conflict, Stored

SCHEMA = "k long, v string"


def table(spark, path, parts=4):
    return Stored(spark, str(path), spark.createDataFrame([], SCHEMA).schema, ["k"], parts)


def rows(spark, *of):
    return spark.createDataFrame(list(of), SCHEMA)


def content(t):
    return {r.k: r.v for r in t.rows().collect()}


def test_changes_return_their_counts(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    assert t.version() == 0 and content(t) == {}
    assert t.insert_ignore(rows(spark, (1, "a"), (2, "b"), (None, "n"), (2, "b2"))) == 3
    assert t.insert_ignore(rows(spark, (2, "z"), (3, "c"), (None, "z"))) == 1
    assert t.replace(rows(spark, (1, "A"), (4, "d"))) == 2
    assert t.update("k >= 3", {"v": F.upper("v")}) == 2 and t.update("k > 99", {"v": F.lit("x")}) == 0
    assert t.delete("k = 2") == 1 and t.delete("k = 2") == 0
    assert content(t) == {1: "A", 3: "C", 4: "D", None: "n"}
    assert t.replace(rows(spark)) == 0 and t.insert_ignore(rows(spark)) == 0
    with pytest.raises(ValueError):
        t.update("true", {"k": F.lit(1)})
    before = content(t)
    assert t.vacuum() > 0 and t.vacuum() == 0 and content(t) == before


def test_an_earlier_version_is_readable_until_it_is_cleaned(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.insert_ignore(rows(spark, (1, "a")))
    t.delete("true")
    assert content(t) == {} and t.read(version=1).count() == 1


def test_a_failed_change_leaves_the_old_table(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.insert_ignore(rows(spark, (1, "a"), (2, "b")))
    with pytest.raises(Exception, match="stop"):
        t.update("true", {"v": F.raise_error(F.lit("stop")).cast("string")})
    assert t.version() == 1 and content(t) == {1: "a", 2: "b"}


def test_of_two_writers_one_wins(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.insert_ignore(rows(spark, (1, "a")))
    other = table(spark, tmp_path / "t")
    old = other.version()
    t.replace(rows(spark, (1, "b")))
    with pytest.raises(Conflict):
        other.rewrite([0, 1, 2, 3], other.parted(rows(spark, (1, "c"))), old)
    assert content(t) == {1: "b"}


def test_only_touched_parts_are_written(spark, tmp_path):
    t = table(spark, tmp_path / "t", 8)
    t.insert_ignore(spark.range(100).select(F.col("id").alias("k"), F.lit("x").alias("v")))
    first = t._places(1)
    t.replace(rows(spark, (5, "y")))
    second = t._places(2)
    assert sum(first[p] != second[p] for p in first) == 1 and len(content(t)) == 100


def points(spark, n=400, width=12, seed=3):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(10)]
    made = [(i, [x + rng.gauss(0, 0.4) for x in centers[i % 10]]) for i in range(n)]
    made += [(n, [0.0] * width), (n + 1, made[0][1]), (n + 2, made[0][1]), (n + 3, None), (None, made[1][1])]
    return spark.createDataFrame(made, "id long, v array<double>")


def key(found):
    return sorted((r.query_id, r.id, r.score, r["rank"]) for r in found.collect())


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return vector_index.VectorIndex(spark, str(tmp_path_factory.mktemp("index") / "i")).build(points(spark), cells=16)


def queries(spark):
    return points(spark).where("id % 25 = 0 AND v IS NOT NULL").select(F.col("id").alias("query_id"), F.col("v").alias("q"))


def test_index_search_is_exact_and_few_cells_find_nine_tenths(spark, index, monkeypatch):
    good = points(spark).where("id IS NOT NULL AND v IS NOT NULL")
    want = retrieval.top_k(queries(spark), good, 5)
    exact = key(want)
    assert key(index.search(queries(spark), 5)) == exact
    assert key(index.search(queries(spark), 5, probes=1, exact=True)) == exact
    assert vector_index.recall(index.search(queries(spark), 5, probes=3), want) >= 0.9
    assert key(index.search(queries(spark), 5, probes=2, threshold=0.5, exact=True)) == key(retrieval.top_k(queries(spark), good, 5, 0.5))
    monkeypatch.setattr(vector_index, "SIDE_ROWS", 0)
    assert key(index.search(queries(spark), 5)) == exact


def test_recall_on_the_given_vectors(spark, tmp_path):
    rows_ = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    all_, some = rows_.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), rows_.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = vector_index.VectorIndex(spark, str(tmp_path / "i")).build(all_).search(some, 5, probes=16)
    assert vector_index.recall(found, retrieval.top_k(some, all_, 5)) >= 0.9


def test_an_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], "id long, v array<double>")
    index = vector_index.VectorIndex(spark, str(tmp_path / "i")).build(none)
    assert index.search(queries(spark), 3).count() == 0 and index.delete(none.select("id")) == 0
    assert index.upsert(points(spark).where("id < 5")) == 5 and index.search(queries(spark), 3, probes=1, exact=True).count() > 0


def plain_links(claims, threshold=0.35):
    sets = {i: (d, set((t or "").lower().replace(" ", "").replace("，", "").replace("。", "")[:40])) for i, d, t in claims}
    links, up = dict.fromkeys(sets, 0), {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        (d, x), (e, y) = sets[a], sets[b]
        if d == e and x and y and len(x & y) / len(x | y) > threshold:
            links[a] += 1
            links[b] += 1
            low, high = sorted((find(a), find(b)))
            up[high] = low
    return sorted((i, links[i], find(i)) for i in sets)


def claims(n=260, seed=5):
    rng = random.Random(seed)
    alphabet = "abcdefghijklmnopqrstuvwxyz0123456789條例法律草案"
    made = [(i, rng.choice(["hot", "hot", "hot", None, "d1", "d2"]), "".join(rng.choice(alphabet[: rng.choice([6, 20, 44])]) for _ in range(rng.choice([1, 3, 8, 30])))) for i in range(n)]
    return made + [(n, "hot", None), (n + 1, "hot", ""), (n + 2, "hot", " ，"), (n + 3, "hot", made[0][2]), (n + 4, "hot", made[0][2])]


@pytest.mark.parametrize("block", [similarity.BLOCK, 40])
@pytest.mark.parametrize("threshold", [0.35, 0.75])
def test_linked_claims_and_components(spark, block, threshold):
    frame = spark.createDataFrame(claims(), "id long, dimension string, issue string")
    assert sorted(map(tuple, similarity.of_claims(frame, threshold, block).collect())) == plain_links(claims(), threshold)


def test_one_hot_dimension_leaves_a_row_for_each_class_and_block(spark):
    hot = spark.range(20_000).selectExpr("id", "'d' AS dimension", "substr(sha2(CAST(id AS STRING), 256), 1, 9) AS issue")
    found = similarity.classes(hot)
    links = similarity.linked_classes(found)
    n = found.count()
    assert n > 2000 and links.count() <= n * 40
    out = similarity.similar(hot)
    assert out.agg(F.sum("n")).first()[0] == 20_000 and out.select("component").distinct().count() == 1


def test_small_dimensions_take_no_rounds(spark, monkeypatch):
    """Components of dimensions that lie in one block are found there, chains of links included."""
    rng = random.Random(6)
    rows = [(n, f"d{n % 23}", "".join(rng.choice("abcdefghijkl0123") for _ in range(rng.randrange(0, 7)))) for n in range(400)]
    frame = spark.createDataFrame(rows, "id long, dimension string, issue string")
    monkeypatch.setattr(similarity, "components", None)
    for threshold in (0.35, 0.6):
        assert sorted(map(tuple, similarity.of_claims(frame, threshold).collect())) == plain_links(rows, threshold)


def test_no_claims(spark):
    assert similarity.of_claims(spark.createDataFrame([], "id long, dimension string, issue string")).count() == 0


INDEX = "pcode string, seen timestamp, current string, abolished boolean"


def seen(spark, *of):
    return spark.createDataFrame(list(of), "pcode string, day string, current string, abolished boolean").select("pcode", F.to_timestamp("day").alias("seen"), "current", "abolished")


def track(spark, path, *drops, late="1 day"):
    from lexloom.streaming import tracker

    for drop in drops:
        drop.write.mode("append").parquet(f"{path}/in")
        tracker.run(spark.readStream.schema(INDEX).parquet(f"{path}/in"), f"{path}/out", f"{path}/state", late=late).awaitTermination()
    return sorted((r.pcode, str(r["at"])[:10], r.old_version, r.new_version, r.status) for r in tracker.found(spark, f"{path}/out").collect())


def test_tracking_goes_on_after_a_restart(spark, tmp_path):
    drops = [
        seen(spark, ("A", "2020-01-01", "v1", False), ("A", "2020-01-01", "v0", False), ("B", "2020-01-05", "v1", True), ("C", "2020-01-01", "v1", False), (None, "2020-01-01", "x", False), ("D", None, "x", False)),
        seen(spark, ("A", "2020-03-01", "v2", False), ("B", "2020-03-01", "v1", None), ("A", "2020-03-02", None, False)),
        seen(spark, ("A", "2020-12-01", "v2", False), ("B", "2021-02-01", "v0", False)),
    ]
    got = track(spark, tmp_path, *drops)
    assert got == [
        ("A", "2020-01-01", None, "v1", "newly_tracked"), ("A", "2020-03-01", "v1", "v2", "changed"), ("A", "2020-03-02", "v2", "", "unchanged"), ("A", "2020-08-29", "v2", None, "missing"), ("A", "2020-12-01", "v2", "v2", "unchanged"),
        ("B", "2020-01-05", None, "v1", "abolished"), ("B", "2020-03-01", None, "v1", "newly_tracked"), ("B", "2020-08-28", "v1", None, "missing"), ("B", "2021-02-01", "v1", "v0", "unchanged"),
        ("C", "2020-01-01", None, "v1", "newly_tracked"), ("C", "2020-06-29", "v1", None, "missing"),
    ]
    from lexloom.streaming import tracker

    index = drops[0].unionByName(drops[1]).unionByName(drops[2])
    assert got == sorted((r.pcode, str(r["at"])[:10], r.old_version, r.new_version, r.status) for r in tracker.history(index).collect())
    assert track(spark, tmp_path) == got


def test_late_rows_change_nothing(spark, tmp_path):
    got = track(spark, tmp_path, seen(spark, ("A", "2020-03-01", "v2", False), ("B", "2020-03-01", "v1", False)), seen(spark, ("A", "2020-02-27", "v9", False), ("A", "2020-03-05", "v2", False), ("A", "2019-01-01", "v9", False)), late="10 days")
    assert [x for x in got if x[0] == "A"] == [("A", "2020-02-27", "v2", "v9", "late"), ("A", "2020-03-01", None, "v2", "newly_tracked"), ("A", "2020-03-05", "v2", "v2", "unchanged")]


def test_many_laws_share_a_state(spark, tmp_path, monkeypatch):
    """Laws are followed one by one in a bucket's state, whose rows do not grow with the laws."""
    from lexloom.streaming import tracker

    monkeypatch.setattr(tracker, "BUCKETS", 3)
    made = [(f"L{n % 40}", f"20{20 + n // 40:02d}-{1 + n * 7 % 12:02d}-{1 + n * 11 % 28:02d}", f"v{n * 13 % 17}", n % 9 == 0) for n in range(160)]
    drops = [seen(spark, *[x for x in made if x[1][:4] == year]) for year in ("2020", "2021", "2022", "2023")]
    index = drops[0].unionByName(drops[1]).unionByName(drops[2]).unionByName(drops[3])
    got = track(spark, tmp_path, *drops)
    assert got == sorted((r.pcode, str(r["at"])[:10], r.old_version, r.new_version, r.status) for r in tracker.history(index).collect()) and any(x[4] == "missing" for x in got)
    seen(spark, ("L1", "2024-01-01", "v1", False)).write.mode("append").parquet(f"{tmp_path}/in")
    stream = tracker.run(spark.readStream.schema(INDEX).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state")
    stream.awaitTermination()
    assert max(x["stateOperators"][0]["numRowsTotal"] for x in stream.recentProgress if x["stateOperators"]) <= 3
