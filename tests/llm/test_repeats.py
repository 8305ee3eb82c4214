import random
import re
from collections import Counter

from lexloom.llm.repeats import levels, remove_repeats


def brute(texts, length):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    shared = [[f"p{k}w{rng.randrange(400)}" for _ in range(rng.randrange(20, 90))] for k in range(6)]
    texts = []
    for _ in range(n):
        w = []
        for _ in range(rng.randrange(0, 4)):
            w += [rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(0, 30))]
            p = rng.choice(shared)
            a = rng.randrange(0, 8)
            w += p[a : len(p) - rng.randrange(0, 8)]
        texts.append(rng.choice([" ", "\n", "  "]).join(w))
    return texts + [None, "", "   ", texts[3], texts[3], "x " * 200, ("y z " * 40).strip(), "é ü ß " * 3]


def run(spark, texts, **how):
    df = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, verdicts string")
    rows = {r.doc_id: r for r in remove_repeats(df.repartition(3), **how).collect()}
    return [(rows[i].n_words, rows[i].n_removed, rows[i].kept_text) for i in range(len(texts))]


def test_against_brute_force(spark):
    texts = corpus(1)
    assert run(spark, texts) == brute(texts, 35)


def test_more_levels(spark):
    texts = corpus(2)
    assert levels(35, 5) == [5, 10, 20, 35]
    assert run(spark, texts, base=5) == brute(texts, 35)


def test_repeated_rows_null_ids_and_empty(spark):
    t = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, t), (1, t), (None, "short"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(df).collect())
    assert got == [(-1, 0, 0, ""), (-1, 1, 0, "short"), (1, 50, 50, ""), (1, 50, 50, "")]
    assert remove_repeats(df.limit(0)).collect() == []
