"""Alignments, passages in common, similar claims and replayed batches against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.functions import udfs
from lexloom.operators import consensus, versions
from lexloom.streaming import feeds


def table_alignment(old, new):
    """The operations by the whole table, removals first where either would do."""
    n, m = len(old), len(new)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in reversed(range(n)):
        for j in reversed(range(m)):
            best[i][j] = best[i + 1][j + 1] + 1 if old[i] == new[j] else max(best[i + 1][j], best[i][j + 1])
    steps, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and old[i] == new[j]:
            steps.append(("=", old[i]))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            steps.append(("-", old[i]))
            i += 1
        else:
            steps.append(("+", new[j]))
            j += 1
    return steps, best[0][0]


def merged(steps):
    """Neighbours of one kind as one; between two equal stretches removals come first."""
    out, gone, come = [], "", ""
    for kind, c in [*steps, ("end", "")]:
        if kind == "-":
            gone += c
        elif kind == "+":
            come += c
        else:
            out += [(k, s) for k, s in (("-", gone), ("+", come)) if s]
            gone = come = ""
            if kind == "=" and out and out[-1][0] == "=":
                out[-1] = ("=", out[-1][1] + c)
            elif kind == "=":
                out.append(("=", c))
    return out


@pytest.mark.parametrize("cells", [udfs.CELLS, 60])
def test_alignment(cells, monkeypatch):
    monkeypatch.setattr(udfs, "CELLS", cells)
    rng = random.Random(cells)
    for _ in range(300):
        old, new = ("".join(rng.choice("abc") for _ in range(rng.randrange(0, 25))) for _ in range(2))
        steps, length = table_alignment(old, new)
        got = udfs.align(old, new)
        assert "".join(s for t, s in got if t != "+") == old and "".join(s for t, s in got if t != "-") == new
        assert sum(len(s) for t, s in got if t == "=") == length
        if cells > 1000:
            assert got == merged(steps)


def test_long_texts_are_aligned_too():
    rng = random.Random(1)
    old = "".join(rng.choice("abcdefgh") for _ in range(20000))
    new = old[:5000] + "XYZ" + old[5000:9000] + old[9100:]
    assert udfs.align(old, new) == [("=", old[:5000]), ("+", "XYZ"), ("=", old[5000:9000]), ("-", old[9000:9100]), ("=", old[9100:])] or sum(len(s) for t, s in udfs.align(old, new) if t == "=") == 19900
    assert udfs.align("", "") == [] and udfs.align("a", "") == [("-", "a")] and udfs.align("", "b") == [("+", "b")]


def test_longest_passage_in_common():
    rng = random.Random(2)
    for _ in range(200):
        texts = ["".join(rng.choice("ab🙂") for _ in range(rng.randrange(0, 20))) for _ in range(rng.randrange(1, 4))]
        first = texts[0]
        best = max((first[i:j] for i in range(len(first) + 1) for j in range(i, len(first) + 1) if all(first[i:j] in t for t in texts)), key=len)
        assert udfs.longest_shared(texts) == best
    assert udfs.longest_shared([]) == ""


def test_similar_claims_lose_no_pair(spark):
    rng = random.Random(3)
    rows = [(i, f"d{i % 3}", "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(0, 9)))) for i in range(150)]
    for threshold in (0.35, 0.6, 0.8):
        chars = {i: set(t) for i, _, t in rows}
        want = {(a, b) for a, d, _ in rows for b, e, _ in rows if a < b and d == e and chars[a] | chars[b] and len(chars[a] & chars[b]) > threshold * len(chars[a] | chars[b])}
        got = {tuple(r) for r in consensus.similar_claims(spark.createDataFrame(rows, "id long, dimension string, issue string"), threshold).collect()}
        assert got == want


def test_as_of_at_and_between_versions(spark):
    v = spark.createDataFrame([("a", "20200101"), ("a", "20210101"), ("b", "20220101")], "k string, version string")
    m = spark.createDataFrame([("a", "20191231"), ("a", "20200101"), ("a", "20201231"), ("a", "20201231"), ("a", "20990101"), ("b", "20200101"), ("c", "20200101")], "k string, moment string")
    got = sorted((r.k, r.moment, r.as_of_version or "") for r in versions.as_of(v, m, "k", "version", "moment").collect())
    assert got == [("a", "20191231", ""), ("a", "20200101", "20200101"), ("a", "20201231", "20200101"), ("a", "20201231", "20200101"), ("a", "20990101", "20210101"), ("b", "20200101", ""), ("c", "20200101", "")]


def test_a_replayed_batch_replaces_its_rows(spark, tmp_path):
    index = "pcode string, current string, abolished boolean"
    spark.createDataFrame([("A", "20210101", False)], index).write.parquet(f"{tmp_path}/in")
    tracked = spark.createDataFrame([("A", "20200101")], "pcode string, baseline string")
    for k in range(2):  # another state folder: the same batch number comes again
        feeds.sync(spark.readStream.schema(index).parquet(f"{tmp_path}/in"), tracked, f"{tmp_path}/out", f"{tmp_path}/state{k}").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").where(F.col("batch") == 0).count() == 1


def test_short_texts_are_compared_as_they_are(monkeypatch):
    from lexloom.functions import udfs

    rng = random.Random(3)
    for _ in range(200):
        made = ["".join(rng.choice("ab行") for _ in range(rng.randrange(0, 14))) for _ in range(rng.randrange(1, 5))]
        monkeypatch.setattr(udfs, "SHORT", -1)
        want = udfs.longest_shared(made)
        monkeypatch.setattr(udfs, "SHORT", 256)
        with monkeypatch.context() as m:
            m.setattr(udfs, "_windows", None)
            assert udfs.longest_shared(made) == want and udfs.longest_shared(made * 3) == want


def test_small_dimensions_travel_once(spark):
    from lexloom.operators import consensus

    rng = random.Random(4)
    rows = [(n, f"d{n % 5 * (n % 3)}", "".join(rng.choice("abcdefg") for _ in range(rng.randrange(0, 6)))) for n in range(90)] + [(90, None, "abc"), (91, None, "abc"), (92, "d1", None)]
    frame = spark.createDataFrame(rows, "id long, dimension string, issue string")
    sets = [(i, d, set(t or "")) for i, d, t in rows if d is not None]
    want = sorted((a, b) for a, d, x in sets for b, e, y in sets if a < b and d == e and x | y and len(x & y) / len(x | y) > 0.5)
    for small in (0, 8, 64):
        assert sorted(map(tuple, consensus.similar_claims(frame, 0.5, small).collect())) == want
    assert consensus.similar_claims(frame, 0.5)._jdf.queryExecution().sparkPlan().toString().count("Join") == 0


def test_a_court_is_looked_for_once(spark):
    from lexloom.functions import citation

    frame = spark.createDataFrame([("臺灣高等法院高雄分院 112 年度 上易字第 7 號",), ("無",), (None,)], "s string").select(citation.case_number(F.col("s")).alias("c"))
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("Contains") + frame._jdf.queryExecution().optimizedPlan().toString().count("contains(") == 1
    assert [tuple(r.c) if r.c else None for r in frame.collect()] == [("臺灣高等法院高雄分院", "112", "上易", "7", "KSH"), None, None]
