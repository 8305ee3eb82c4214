"""Text search, paths and linked hashes against plain versions."""

import hashlib
import itertools
import math
import random

import pytest

from lexloom.operators import graph, text_index, versions


def texts(seed=2, n=120):
    rng = random.Random(seed)
    vocab = ["law", "Law", "act", "行政", "法", "regulation", "reg", "a", "of", "état", "x9"]
    made = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 25)))) for i in range(n)]
    return made + [(n, None), (n + 1, ""), (n + 2, "ab"), (n + 3, "law " * 500), (None, "law act")]


@pytest.mark.parametrize("side", [text_index.SIDE_ROWS, 0])
def test_substrings(spark, tmp_path, monkeypatch, side):
    monkeypatch.setattr(text_index, "SIDE_ROWS", side)
    rows = texts()
    wanted = [(1, "law act"), (2, "egul"), (3, "法"), (4, "ab"), (5, ""), (6, None), (7, "nothing like it"), (8, "行政 法"), (9, "law"), (10, "Law o"), (11, "aaaa"), (12, "w l")]
    index = text_index.TrigramIndex(spark, str(tmp_path / "t")).build(spark.createDataFrame(rows, "id long, text string"))
    found = index.search(spark.createDataFrame(wanted, "word_id int, word string"))
    assert sorted(map(tuple, found.collect())) == sorted((w, i) for w, x in wanted if x for i, t in rows if i is not None and t and x in t)


def test_equal_words_are_looked_for_once(spark, tmp_path):
    """Copies of a word meet no texts of their own, and places of a trigram are compared with whole words only."""
    rows = [(i, f"ring {i:06d}") for i in range(400)] + [(400, "rin 0ing"), (401, "aaaa")]
    words = ["rin"] * 300 + [f"0{n:03d}" for n in range(100)] + ["aaa", "ring 0", "no", "1", "400 "]
    index = text_index.TrigramIndex(spark, str(tmp_path / "t")).build(spark.createDataFrame(rows, "id long, text string"))
    wanted = spark.createDataFrame(list(enumerate(words)), "word_id int, word string")
    assert sorted(map(tuple, index._met(wanted).collect())) == sorted((w, i) for w in set(words) for i, t in rows if w in t)
    want = {n: [i for i, t in rows if w in t] for n, w in enumerate(words)}
    assert sorted(map(tuple, index.counted(wanted).collect())) == [(n, len(x), min(x), max(x)) for n, x in sorted(want.items()) if x]


def plain_bm25(rows, queries, k):
    docs = {i: text_index.words(t or "") for i, t in rows if i is not None}
    mean, n = sum(map(len, docs.values())) / len(docs), len(docs)
    out = []
    for q, asked in queries:
        score = {}
        for w in set(text_index.words(asked or "")):
            df = sum(w in d for d in docs.values())
            for i, d in docs.items():
                if tf := d.count(w):
                    score[i] = score.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        best = sorted(score, key=lambda i: (-round(score[i], 9), i))[:k]
        out += [(q, i, round(score[i], 6), r + 1) for r, i in enumerate(best)]
    return sorted(out)


def test_ranked_search_and_phrases(spark, tmp_path):
    rows = texts()
    index = text_index.WordIndex(spark, str(tmp_path / "w")).build(spark.createDataFrame(rows, "id long, text string"))
    queries = [(1, "LAW act"), (2, "regulation 行政 état"), (3, "unknown"), (4, None), (5, "law law of")]
    found = index.search(spark.createDataFrame(queries, "query_id int, query string"), 7)
    assert sorted((r.query_id, r.id, round(r.score, 6), r["rank"]) for r in found.collect()) == plain_bm25(rows, queries, 7)
    phrases = [(1, "law act"), (2, "law law"), (3, "of a law"), (4, "no such"), (5, ""), (6, "行政")]
    want = []
    for q, p in phrases:
        asked = text_index.words(p)
        for i, t in rows:
            own = text_index.words(t or "")
            times = sum(own[k : k + len(asked)] == asked for k in range(len(own) - len(asked) + 1)) if asked else 0
            if times and i is not None:
                want.append((q, i, times))
    assert sorted(map(tuple, index.phrases(spark.createDataFrame(phrases, "query_id int, phrase string")).collect())) == sorted(want)


def test_places_make_no_row_for_each_phrase(spark, tmp_path):
    """Many phrases of one word, copies of phrases, runs that overlap; places meet phrases as wholes."""
    rows = [(n, " ".join(["a", "b", f"c{n % 5}", "a", "a"][k % (n % 4 + 2)] for k in range(n % 17))) for n in range(60)]
    phrases = [f"a c{n % 7}" for n in range(40)] + ["a b", "a b", "b", "a a a", "c1 a b", "b a b a"]
    index = text_index.WordIndex(spark, str(tmp_path / "w")).build(spark.createDataFrame(rows, "id long, text string"))
    found = index.phrases(spark.createDataFrame(list(enumerate(phrases)), "query_id int, phrase string"))
    cut = lambda t, p: sum(t.split()[k : k + len(p.split())] == p.split() for k in range(len(t.split())))
    assert sorted(map(tuple, found.collect())) == sorted((q, i, cut(t, p)) for q, p in enumerate(phrases) for i, t in rows if cut(t, p))
    assert "start" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_search_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "id long, text string")
    asked = spark.createDataFrame([(1, "word")], "query_id int, query string")
    assert text_index.WordIndex(spark, str(tmp_path / "w")).build(none).search(asked, 3).count() == 0
    assert text_index.TrigramIndex(spark, str(tmp_path / "t")).build(none).search(asked.toDF("word_id", "word")).count() == 0


def test_shortest_paths(spark):
    rng = random.Random(9)
    pairs = {(rng.randrange(25), rng.randrange(25)) for _ in range(30)} | {(3, 3)}
    around = {i: {b for a, b in pairs if a == i and b != i} | {a for a, b in pairs if b == i and a != i} for i in range(25)}
    want = {}
    for s in (0, 1, 2):
        before, front = {s: None}, [s]
        for d in range(1, 5):
            new = {}
            for x in front:
                for y in around[x]:
                    if y not in before:
                        new[y] = min(x, new.get(y, x))
            before |= new
            front = list(new)
            for y in new:
                path, at = [y], y
                while before[at] is not None:
                    at = before[at]
                    path.append(at)
                want[s, y] = (d, path[::-1])
    edges = spark.createDataFrame(sorted(pairs), "src long, dst long")
    starts = spark.createDataFrame([(0,), (1,), (2,), (1,), (77,)], "id long")
    got = {(r.start, r.id): (r.depth, r.path) for r in graph.shortest_paths(edges, starts, 4).collect()}
    assert got == want
    some = graph.shortest_paths(edges, starts, 4, spark.createDataFrame([(5,), (6,)], "id long")).collect()
    assert {(r.start, r.id) for r in some} == {k for k in want if k[1] in (5, 6)}
    assert graph.shortest_paths(edges.limit(0), starts, 3).count() == 0


def test_a_change_changes_all_later_hashes(spark):
    rows = [(k, n, f"{k}{n}") for k in ("a", "b") for n in range(50)] + [(None, 1, None), (None, 2, "x")]
    frame = lambda of: spark.createDataFrame(of, "k string, n int, payload string")
    got = {(r.k, r.n): (r.hash, r.prev_hash) for r in versions.linked_hashes(frame(rows), "k", ["n"], "payload").collect()}
    for k, own in itertools.groupby(rows, key=lambda r: r[0]):
        last = ""
        for _, n, p in own:
            assert got[k, n][1] == last
            last = hashlib.sha256(f"{last}|{p or ''}".encode()).hexdigest()
            assert got[k, n][0] == last
    changed = [(k, n, "other" if (k, n) == ("a", 20) else p) for k, n, p in rows]
    new = {(r.k, r.n): (r.hash, r.prev_hash) for r in versions.linked_hashes(frame(changed), "k", ["n"], "payload").collect()}
    assert {x for x in got if got[x] != new[x]} == {("a", n) for n in range(20, 50)}
