"""Overlaps against all pairs."""

import random

import pytest

from lexloom.operators import intervals


def made(n, seed, far):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        start = rng.randrange(-far, far)
        out.append((rng.choice(["hot", "hot", "a", "b", None]), i, None if rng.random() < 0.05 else start, None if rng.random() < 0.05 else start + rng.choice([0, 1, 2, 3, 17, 64, 65, far, -2])))
    return out


@pytest.mark.parametrize("hot", [intervals.HOT, 7])
@pytest.mark.parametrize("far", [20, 5000])
def test_overlaps(spark, hot, far):
    a, b = made(150, 1, far), made(150, 2, far)
    a.append(a[0])
    schema = "k string, id long, start long, end long"
    inf = float("inf")
    span = lambda r: (-inf if r[2] is None else r[2], inf if r[3] is None else r[3])
    want = sorted((x[0], x[1], y[1]) for x in a for y in b if x[0] is not None and x[0] == y[0] and span(x)[0] < span(x)[1] and span(y)[0] < span(y)[1] and span(x)[0] < span(y)[1] and span(y)[0] < span(x)[1])
    found = intervals.overlapping(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k"], hot=hot)
    assert sorted((r.k, r.l.id, r.r.id) for r in found.collect()) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_no_intervals(spark):
    none = spark.createDataFrame([], "k string, id long, start long, end long")
    assert intervals.overlapping(none, none, ["k"]).count() == 0


def test_keys_with_few_pairs_meet_without_cells(spark):
    """Rows of small keys travel once; a key with many pairs for its rows goes by cells; nulls are open on either way."""
    a = [(k, s, s + w if w else None, f"a{k}{s}{w}") for k in (1, 2, 3) for s in range(0, 60 if k == 3 else 9, 2) for w in (0, 1, 5)] + [(1, None, 4, "open"), (None, 0, 9, "none"), (2, 5, 5, "empty")]
    b = [(k, s, s + 3, f"b{k}{s}") for k in (1, 2, 3) for s in range(60 if k == 3 else 6)] + [(1, None, None, "all"), (None, 0, 9, "none")]
    schema = "k int, start int, end int, name string"
    x, y = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    low, high = -(10**6), 10**6
    span = lambda r: (low if r[1] is None else r[1], high if r[2] is None else r[2])
    want = sorted((k, r[3], q[3]) for r in a for q in b for k in (r[0],) if k is not None and k == q[0] and span(r)[0] < span(r)[1] and max(span(r)[0], span(q)[0]) < min(span(r)[1], span(q)[1]))
    for few in (0, 20, 10**6):
        found = intervals.overlapping(x, y, ["k"], few=few)
        assert sorted((r.k, r.l.name, r.r.name) for r in found.collect()) == want
    assert "_cell" not in found._jdf.queryExecution().toString() and "_cell" in intervals.overlapping(x, y, ["k"], few=20)._jdf.queryExecution().toString()
