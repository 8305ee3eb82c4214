import random

import corpus_pipeline
from lexloom.llm import neardup, packing, quality, secrets

from . import brute


def test_against_plain_version(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    texts = ["\n".join(" ".join(word() for _ in range(12)) for _ in range(6)) for _ in range(40)]
    texts += [f"{word()} {word()}\n" + "the line that all of these have 12\n" * (k % 2 + 1) + "\n".join(" ".join(word() for _ in range(12)) for _ in range(4)) + "\n The  line THAT all of these have 99" * (k % 3 == 0) for k in range(30)]
    depleted = len(texts)
    texts += ["the line that all of these have 77\n" + " ".join(word() for _ in range(21)), "\n".join(["the line that all of these have 77"] * 3) + "\n" + " ".join(word() for _ in range(15))]
    texts += [texts[0], texts[1] + " more", "too short", None, "again and " * 40, texts[5] + "\npassword = hunter2hunter2"]
    bench = [(1, " ".join(texts[7].split()[10:40]))]
    rows = [(i, t, "en", "s0", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = sorted(brute.quality_rules([(i, t, "s0") for i, t in enumerate(texts)], quality.MIN_DOCS, quality.SHARE, quality.KEEP).items())
    left = dict(docs)
    assert depleted in left and depleted + 1 not in left and sum("that all of these" in t.lower() for t in left.values()) == 1
    kept = brute.near(docs, neardup.STAGE_PERCENT, neardup.STAGE_SHINGLE)
    docs = [(i, t) for i, t in docs if kept[i][2]]
    leaks = brute.leaks(docs, bench)
    docs = [(i, secrets.redact(t, secrets.all_spans(t))) for i, t in docs if not leaks[i][4]]
    want = {i: brute.token_pieces(t) for i, t in docs}
    assert 7 not in want and texts.index('too short') not in want and len(want) > 60

    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    assert {i: sorted(v) for i, v in got.items()} == want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "packing"]
    assert quality.MIN_WORDS == 20 and packing.SEQUENCE == 2048


def test_empty_and_odd_tables(spark, tmp_path):
    kind = "doc_id string, text string, `a.b` int, _id int, removed string, source string, kept boolean"
    bench = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    body = " ".join("abcdefghij"[k % 10] * (k // 10 + 1) for k in range(40))
    rows = [(i, t, 1, 2, "r", s, True) for i, t, s in ((None, None, None), (None, body, None), ("x", body, "s"), ("x", body, "s"), ("y", "", "s"), ("z", " ".join(reversed(body.split())) + " password=hunter2hunter2 " + "q" * 20000, "s"), (None, body.upper() + " other words " * 3 + " ".join(f"w{k}" for k in range(60)), None))]
    docs = spark.createDataFrame(rows, kind)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == [], name
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "a.b", "_id", "removed", "source", "kept"], name
    texts = {r.text for r in docs.collect()}
    assert len(texts) == docs.count() == 3 and not any("hunter2" in t for t in texts)
    assert corpus_pipeline.packing(spark, docs.limit(0), "").collect() == []
