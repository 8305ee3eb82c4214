"""Each operator against a plain version, with nulls, empties, long texts, ties, repeats and clashing extra columns."""

import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lexloom.llm import decontaminate, html, neardup, packing, quality, secrets, toxicity, urls, weaklabel

from . import brute

KEY = "AKIA" + "ABCDEFGH12345678"
HEXES = "0123456789abcdef" * 4


def corpus(seed=3, n=120):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgéü") for _ in range(rng.randrange(1, 7))) for _ in range(500)]
    base = [[rng.choice(vocab) for _ in range(rng.randrange(25, 300))] for _ in range(40)]
    texts = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 12)):
            w[rng.randrange(len(w))] = rng.choice(vocab).upper() if rng.random() < 0.5 else rng.choice(vocab)
        lines, at = [], 0
        while at < len(w):
            k = rng.randrange(1, 25)
            lines.append(" ".join(w[at : at + k]))
            at += k
        if rng.random() < 0.3:
            lines += [lines[0], "", "# a | b $ <c>", "same line 12 for all"]
        texts.append("\n".join(lines))
    odd = [None, "", "  \n\t ", "one", "two words", "Two WORDS", "a b c", "x " * 400, "é\u00a0 à  b\u2003\n\n c", "tail blank \n", "a  b   c\n\n\nd", " <|endoftext|> x", "日本語 テキスト 🙂 🙂", texts[0], texts[0], texts[1].swapcase(), " ".join(rng.choice(vocab) for _ in range(30000))]
    odd += [f"say password = {HEXES[:20]} and Token:'abcDEF12345' api_key=\"short\" {KEY} {HEXES} xx{HEXES[:31]}z sſecret=aaaaaaaaaa", "token=token=abcdefgh1 \x0b AKIA123 AKIAabc"]
    return list(enumerate(texts + odd))


@pytest.fixture(scope="module")
def docs():
    return corpus()


@pytest.fixture(scope="module")
def frame(spark, docs):
    rows = [(i, t, ("s1", "s2", None)[i % 3], "clash", 7, True) for i, t in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, line string, n long, kept boolean").repartition(3).cache()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_near_duplicates(frame, docs):
    want = brute.near(docs)
    got = by_id(neardup.near_duplicates(frame))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == want
    left = neardup.drop_near_duplicates(frame)
    assert left.columns == frame.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, w in want.items() if w[2])


def test_near_duplicates_of_one_large_group(spark):
    rng = random.Random(5)
    base = [str(rng.randrange(10**6)) for _ in range(120)]
    docs = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = str(rng.randrange(10**6))
        docs.append((i, " ".join(w)))
    got = by_id(neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == brute.near(docs)


def test_near_duplicates_repeated_rows(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (2, "a b c d"), (None, "a b c d"), (7, None), (7, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == [(-1, 2, 2, False), (2, 2, 2, True), (5, 2, 2, False), (5, 2, 2, False), (7, 0, 7, True), (7, 0, 7, True)]


def test_near_duplicates_at_other_thresholds(spark, frame, docs):
    got = by_id(neardup.near_duplicates(frame, 80, 5))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == brute.near(docs, 80, 5)
    rng = random.Random(6)
    pairs = []
    for i in range(150):
        w = [str(rng.randrange(10**6)) for _ in range(200)]
        pairs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:150] + [str(rng.randrange(10**6)) for _ in range(50)]))]
    got = by_id(neardup.near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string"), 59, 5))
    want = brute.near(pairs, 59, 5)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == want and sum(w[2] for w in want.values()) == 150
    assert [neardup.trees(p) for p in (100, 85, 80)] == [1, 16, 22] and neardup.least_agreement(1024, 80) < 755


def test_the_stage_takes_five_words(spark):
    w = [f"w{k}" for k in range(400)]
    edited = [f"x{k}" if k % 40 == 20 else x for k, x in enumerate(w)]
    close = [f"y{k}" if k % 80 == 30 else x for k, x in enumerate(w)]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate((w, edited, close))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == [0, 1]


def test_different_texts_of_null_and_repeated_ids_stay(spark):
    texts = ["a b c d", "e f g h", "i j k l", "m n o p", "q r s t", "q r s t", "q r s t"]
    rows = list(zip([None, None, 5, 5, None, 5, 9], texts, strict=True)) + [(None, ""), (None, " ")]
    left = neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or -1, r.text) for r in left.collect()) == [(-1, ""), (-1, " "), (-1, "a b c d"), (-1, "e f g h"), (5, "i j k l"), (5, "m n o p"), (5, "q r s t")]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.c: r.comp for r in neardup.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def items_of(docs):
    cut = lambda i, a, b: " ".join((docs[i][1] or "").split()[a:b])
    return [(1, cut(3, 2, 30)), (2, cut(5, 0, 12)), (10, cut(3, 5, 16)), (3, None), (4, ""), (5, "two words"), (6, cut(9, 3, 10)), (7, "..."), (8, "ONE"), (8, cut(3, 2, 30)), (9, "zz " * 15)]


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_ROWS, 0])
def test_decontamination(spark, frame, docs, limit, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    items = items_of(docs)
    bench = spark.createDataFrame([(*x, "w") for x in items], "item_id long, text string, w string")
    want = brute.leaks(docs, items)
    got = by_id(decontaminate.contaminated_words(frame, bench))
    assert {i: (r.n_words, r.n_hit, len(r["items"]), brute.sha(",".join(r["items"])), r.n_hit > 0) for i, r in got.items()} == want
    left = decontaminate.drop_contaminated(frame, bench)
    assert left.columns == frame.columns and {r.doc_id for r in left.collect()} == {i for i, w in want.items() if not w[4]}


def test_decontamination_with_empty_sides(spark, frame):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.contaminated_words(frame, bench).collect()} == {0}
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.contaminated_words(frame.limit(0), some).collect() == []


def test_quality_base_and_lines(spark, frame, docs):
    got = by_id(quality.judge(frame))
    for i, t in docs:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality_base(t)
    line, body = "Common boiler plate LINE 7", lambda k: " ".join("".join(chr(97 + int(c, 16)) for c in hashlib.md5(f"{k}-{j}".encode()).hexdigest()[:6]) for j in range(30))
    rows = [(k, f"{body(k)}\ncommon  boiler plate line {k % 10}", "h") for k in range(30)] + [(99, line + "\n" + " ".join("pqrst"[j % 5] * (j // 5 + 1) for j in range(18)), "h"), (98, f"{line}\n{body(98)}", "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = by_id(quality.judge(df, min_docs=20))
    assert got[0].n_removed_words == 0 and all(got[k].n_removed_words == 5 for k in range(1, 30)) and got[98].n_removed_words == 0
    assert got[99].n_removed_words == 5 and not got[99].kept and not got[99].base_failed and got[5].kept
    clean = by_id(quality.apply_rules(df, min_docs=20))
    assert set(clean) == {*range(30), 98} and clean[4].text == body(4) + "\n" and clean[0].text == rows[0][1]


def test_a_line_counts_each_copy_of_a_text_and_a_repeated_row_once(spark):
    body = lambda k: " ".join(f"{'abcdefghij'[k % 10]}{'klmnopqrst'[j % 10]}{'uvwxyz'[j // 10]}" for j in range(30))
    rows = [(k, f"{body(k % 10)}\nseen in all copies", "h") for k in range(30)] + [(k, body(k) + " own", "h") for k in range(100, 130)] + [(200, f"{body(3)} other\nseen in one", "g")] * 60
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_docs=20, share=0.5).collect()
    # 30 of the host's 60 documents have the line, in 10 texts; the other 60 rows are one document
    assert {r.doc_id: r.n_removed_words >= 4 for r in got} == {k: 0 < k < 30 for k in [*range(30), *range(100, 130), 200]}
    rows += [(300, "a repeated row of no line above", "h")] * 50
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_docs=20, share=0.49).collect()
    assert {r.doc_id for r in got if r.n_removed_words >= 4} == set(range(1, 30))


def test_secrets(frame, docs):
    got = by_id(secrets.find_secrets(frame))
    for i, t in docs:
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex, brute.sha(r.base_spans)) == brute.secret_base(t)
    assert secrets.is_random("sk4Zq9Xv7Lw2Bt8Rm3Nc6Hy")
    for known in ("d41d8cd98f00b204e9800998ecf8427e", "123e4567-e89b-12d3-a456-426614174000", "20240101120000123456", "internationalization", "a-long-file-name-with-words-2024"):
        assert not secrets.is_random(known)
    text = f"x {KEY} y"
    assert secrets.redact(text, secrets.all_spans(text)) == "x [SECRET] y"
    left = by_id(secrets.redact_secrets(frame))
    assert left[0].text == docs[0][1] and HEXES not in left[len(docs) - 2].text


def test_random_strings_whatever_stands_around_them():
    key, other = "sk4Zq9Xv7Lw2Bt8Rm3Nc6Hy", "Qz7xW4kP9vJ2mR8tY5bN3cL6"
    found = lambda text: [text[i:j] for k, i, j in secrets.all_spans(text) if k == 3]
    for text in (f"key:{key} x", f"Bearer:{key}", f"https://example.com/a/b?page=2&sig={key}", f"see {key}.{other}", f"x%{key}", f"?{key}", f"u@{key}", f"https://{key}:x@example.com/a", f"https://hooks.example.com/services/T0000/B0000/{key}", f"{key}@mail.example.com", f"https://example.com/a/{key}?x=1", f"https://{key}.example.com/"):
        assert any(key in f for f in found(text)), text
    assert found(f"{key}.{other}") == [key, other] and found(f"{HEXES}/{key}") == ["/" + key] and found(f"{KEY}/{key}") == ["/" + key]
    assert found("information_" * 8 + "=" + key) == [key]
    for text in ("mail john.smith.of.the.office4711@mail.example.com", "https://www.example.com/en/how-to-keep-your-own-house-clean/index.html", "https://example.com/files/d41d8cd98f00b204e9800998ecf8427e/20240101120000123456", "id=123e4567-e89b-12d3-a456-426614174000", "D41D8CD98F00B204E9800998ECF8427E", "2024/01/01-12:00 20240101120000123456", "internationalization_of_the_application"):
        assert not found(text), text
    assert found(f"https://example.com/{key}/{other}") == [key, other]
    rng = random.Random(12)
    for alphabet in ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"):
        runs = ["".join(rng.choice(alphabet) for _ in range(20)) for _ in range(500)]
        assert sum(secrets.is_random(r) for r in runs) >= 495


def test_packing(frame, docs):
    rows = packing.pack(frame).collect()
    own, bins = {}, {}
    for r in rows:
        own.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in docs:
        assert sorted(own[i]) == [(k, *p) for k, p in enumerate(brute.token_pieces(t))]
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    assert len(bins) <= 1.1 * sum(r.length for r in rows) / packing.SEQUENCE + 1
    assert packing.pack(frame.limit(0)).collect() == []


def test_packer_takes_the_best_fit_and_closes_the_fullest():
    p = packing.Packer(10, 2)
    assert [p.add(n, n) for n in (6, 7)] == [None, None]
    assert p.add(3, 3) == [7, 3]
    assert p.add(8, 8) is None
    assert p.add(9, 9) == [9]
    assert sorted(p.rest()) == [(6, [6]), (8, [8])]


def test_toxicity(spark):
    rng = random.Random(1)
    vocab = [f"w{rng.randrange(3000)}" + "abcdefgh"[k % 8] for k in range(600)]
    bad = ["idiotic", "scummy", "vilest"]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(vocab) for _ in range(60)]
        toxic = int(rng.random() < 0.2)
        if toxic:
            w[rng.randrange(60)] = rng.choice(bad)
            w[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(w), "x"))
        labels.append((i, toxic))
    rows += [(1000, None, "x"), (1001, "", "x"), (1001, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = toxicity.score_toxicity(df, spark.createDataFrame(labels + [(1, None)], "doc_id long, toxic int")).collect()
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    truth = dict(labels)
    assert len(held) > 200 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert len(got) == 903 and all(0 <= r.score <= 1 for r in got)
    none = toxicity.score_toxicity(df, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert {r.score for r in none} == {0.0}


def example_frame(spark, rows):
    """(id, text, label) as examples in the operator's form, with their documents."""
    df = spark.createDataFrame([(i, t, y) for i, t, y in rows], "doc_id long, text string, toxic int").selectExpr("xxhash64(text) AS h", "doc_id", "toxic", "text")
    return df, df.select("doc_id", "text")


def test_copies_of_a_toxic_text_do_not_teach_its_words(spark):
    rng = random.Random(8)
    vocab = [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyzabcd'[k // 100]}x" for k in range(800)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    one = [f"own{'abcdefghij'[k % 10] * (k // 10 + 1)}" for k in range(60)]
    rows = [(k, " ".join([*one[:k % 50], "and", *one[k % 50:], "vilest"]), 1) for k in range(30)]
    rows += [(100 + k, " ".join([*text(60), "vilest"]), 1) for k in range(30)] + [(200 + k, " ".join(text(60)), 0) for k in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t, _ in rows])], ["text"])
    kin = toxicity.families(list(toxicity.near_copy_keys(batch)))
    assert set(kin[:30]) == {0} and len(set(kin[30:])) == 330
    vocabulary, weight, telling, index = toxicity.build(*example_frame(spark, rows))
    terms = lambda *texts: toxicity.Terms(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), telling)
    assert set(telling.tolist()) == set(toxicity.Terms(pa.RecordBatch.from_arrays([pa.array(["vilest"])], ["text"])).hash.tolist())
    vile, own, copy = toxicity.vectors(terms("some vilest words", "ownaa", rows[40][1]), vocabulary, weight)
    assert index.score(*vile)[0] > 0.9 and index.score(*own)[0] < 0.5 and index.ids[index.score(*copy)[1][0]] == rows[40][0]


def test_block_max_search_is_exact():
    rng = np.random.default_rng(0)
    vectors = []
    for _ in range(2000):
        at = np.sort(rng.choice(40, rng.integers(1, 6), replace=False))
        vectors.append((at, rng.random(len(at))))
    vectors += vectors[:30]
    index = toxicity.Index(40, vectors, [0] * 2030, list(range(2030)), [*range(2000), *range(30)])
    for e, (t, w) in enumerate(vectors[:50]):
        mine = dict(zip(t.tolist(), w.tolist(), strict=True))
        scores = sorted((-round(sum(x * mine.get(k, 0) for k, x in zip(u.tolist(), v.tolist(), strict=True)), 12), i) for i, (u, v) in enumerate(vectors))
        assert list(zip(*(x.tolist() for x in index.nearest(t, w)), strict=True)) == [(-s, i) for s, i in scores[: toxicity.K] if s < 0]
        scores = [x for x in scores if index.family[x[1]] != e]
        assert list(zip(*(x.tolist() for x in index.nearest(t, w, e)), strict=True)) == [(-s, i) for s, i in scores[: toxicity.K] if s < 0]


def test_toxicity_against_a_plain_version(spark):
    rng = random.Random(21)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for i in range(420):
        w = [vocab[min(399, int(rng.expovariate(1 / 60)))] for _ in range(rng.randrange(5, 60))]
        toxic = int(rng.random() < 0.25)
        w += ["Scummiest" if k % 2 else "scummy" for k in range(rng.randrange(1, 4))] if toxic and rng.random() < 0.9 else []
        rng.shuffle(w)
        docs.append((i, " ".join(w)))
        labels += [(i, toxic)] if i % 4 else []
    docs += [(900, None), (901, ""), (902, docs[5][1]), (903, "zzz nothing known")]
    want = brute.toxicity(docs, labels, toxicity)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, score string, h int")
    rows = toxicity.score_toxicity(df.repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert {r.doc_id: round(r.score, 6) for r in rows} == {i: round(s, 6) for i, (s, _) in want.items()}
    # where cosines tie to the last digits the order of places decides in either version
    assert sum(r.evidence == want[r.doc_id][1] for r in rows) >= len(rows) - 4
    assert toxicity.score_toxicity(df.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).collect() == []


def test_url_rules_and_templates(spark):
    cases = [("http://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"), ("https://example.net/de/", "example.net", "/de/", "net/", "block"), ("http://x.net", "x.net", "", None, "allow"),
             ("http://q.example.com/de/5", "q.example.com", "/de/5", "example.com/de/", "block"), ("http://badexample.com/de/5", "badexample.com", "/de/5", None, "allow"), ("http://w.org/fr/", "w.org", "/fr/", "org/fr/", "allow"),
             (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("://", "", "", None, "allow"), ("http://h#f", "h", "", None, "allow"), ("http://É.Org/FR/", "É.org", "/FR/", None, "allow"), ("a://b://c", "b:", "//c", None, "allow")]
    df = spark.createDataFrame([(i, c[0], "e") for i, c in enumerate(cases)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}
    rules = (("spam.example.org", "/x/1", "block"), ("spam.example.org", "/ok", "allow"))
    pages = [f"http://spam.example.org/x/{k}" for k in range(1, 200)] + [f"http://spam.example.org/ok/{k}" for k in range(60)] + [f"http://fine.example.org/x/{k}" for k in range(50)]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    rows = urls.filter_urls(df, rules).collect()
    assert {r.verdict for r in rows if "/x/" in r.path and r.host.startswith("spam")} == {"block"}
    assert {r.verdict for r in rows if "/ok/" in r.path or r.host.startswith("fine")} == {"allow"}
    assert {r.template for r in rows if r.path == "/x/77"} == {"spam.example.org/x/{n}", "fine.example.org/x/{n}"} or {r.template for r in rows if r.path == "/x/77"} == {"spam.example.org/x/{n}"}
    assert urls.filter_urls(df.limit(0)).collect() == []


def test_urls_of_small_and_large_hosts_have_equal_verdicts(spark):
    pages = [f"http://{host}.example.com/{lang}/{k}.html" for host, size in (("small", 1), ("large", 20)) for lang, n in (("de", 12), ("fr", 3), ("es", 4), ("en", 2)) for k in range(n * size)]
    pages += [f"http://{host}.example.com{end}" for host in ("small", "large") for end in ("", "/", "/about")]
    rows = urls.filter_urls(spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")).collect()
    assert {(r.host, r.path) for r in rows if r.verdict == "block"} == {(r.host, r.path) for r in rows if r.path.startswith("/de/")}


def test_urls_are_told_apart_at_any_depth(spark):
    rules = (("h.org", "/a/b/c/d/e/f/g/bad/1", "block"), ("h.org", "/a/b/c/d/e/f/g/good/1", "allow"))
    pages = [f"http://h.org/a/b/c/d/e/f/g/{side}/{k}" for side in ("bad", "good") for k in range(200)]
    rows = urls.filter_urls(spark.createDataFrame(list(enumerate(pages)), "page_id long, url string"), rules).collect()
    assert {r.template for r in rows} == {"h.org/a/b/c/d/e/f/g/bad/{n}", "h.org/a/b/c/d/e/f/g/good/{n}"}
    assert {r.path for r in rows if r.verdict == "block"} == {r.path for r in rows if "/bad/" in r.path}


def test_weak_labels(spark):
    rng = random.Random(2)
    sentence = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(12)).capitalize() + "."
    good = ["\n".join(sentence() for _ in range(8)) for _ in range(300)]
    junk = ["\n".join(" ".join(w.upper() + "!!" for w in sentence().split()) for _ in range(8)) for _ in range(60)] + [" ".join(w + "%%%" for w in " ".join(good[k].split()).split()) for k in range(60)]
    df = spark.createDataFrame(list(enumerate(good + junk)) + [(9000, None), (9001, ""), (9002, " \n ")], "doc_id long, text string")
    got = by_id(weaklabel.classify(df))
    assert sum(got[i].kept for i in range(300)) >= 295 and sum(got[i].kept for i in range(300, 420)) <= 6
    assert [(got[i].score, got[i].kept) for i in (9000, 9001, 9002)] == [(0.0, False)] * 3
    assert weaklabel.classify(df.limit(0)).collect() == []


def test_copies_leave_room_for_other_texts_in_the_sample(spark):
    rng = random.Random(7)
    sentence = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(12)).capitalize() + "."
    good = ["\n".join(sentence() for _ in range(8)) for _ in range(100)]
    junk = ["\n".join(" ".join(w.upper() + "!!" for w in sentence().split()) for _ in range(8)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(good + junk)), "doc_id long, text string")
    least = df.selectExpr("doc_id", "text", "xxhash64(text) AS h").orderBy("h").first()
    copies = spark.createDataFrame([(1000 + k, least.text) for k in range(150)], "doc_id long, text string")
    got = by_id(weaklabel.classify(df.union(copies), sample=120))
    assert sum(got[i].kept for i in range(100)) >= 95 and sum(got[i].kept for i in range(100, 160)) <= 5


def test_expectation_maximisation_finds_the_accuracies():
    rng = np.random.default_rng(4)
    truth = rng.random(20000) < 0.7
    right = [0.9, 0.8, 0.6]
    votes = np.stack([np.where(rng.random(20000) < a, truth, ~truth) for a in right], 1)
    patterns, counts = np.unique(np.where(votes, 1, 2), axis=0, return_counts=True)
    _, table, prior = weaklabel.estimate(patterns, counts)
    assert abs(prior - 0.7) < 0.05 and all(abs(table[1, k, 1] - a) < 0.05 for k, a in enumerate(right))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>x{}</style><script>var a="</p>";</script></head>
<body><nav><ul><li>One<li>Two<ul><li>Deep</ul><li>Three</ul></nav><!-- gone --><p>First &amp; second
 line<p>New <b>bold</b> text<br>after<div hidden>no</div><div style="color:red; DISPLAY: none">no</div>
<ol start=3><li>a<li><p>b</ol><table><tr><th>Name<th>N<tr><td>Longer name<td>1<tr><td>x<td>22</table><pre>
 keep   blanks
  here</pre>tail < 5 &lt; 6 <unknown>kept</unknown></p></body></html>"""


def test_html():
    assert html.render(PAGE) == "- One\n- Two\n  - Deep\n- Three\n\nFirst & second line\n\nNew bold text\nafter\n\n3. a\n\n4. b\n\nName         N\nLonger name  1\nx            22\n\n keep   blanks\n  here\n\ntail < 5 < 6 kept"
    for odd in (None, "", "<", "<p", "</p>", "<table><td>x", "<div>" * 3000 + "deep", "<ul><li><table><tr><td>y</ul>", "<!-- never closed", "<a href='x>y", "<script>never closed"):
        assert isinstance(html.render(odd), str)
    assert "deep" in html.render("<div>" * 3000 + "deep")


def test_html_keeps_all_words(spark):
    rng = random.Random(9)
    tags = ["p", "div", "b", "li", "ul", "table", "tr", "td", "span", "h2", "section", "blockquote", "dd", "ol"]
    for _ in range(200):
        words, parts = [], []
        for k in range(30):
            t = rng.choice(tags)
            parts.append(rng.choice([f"<{t}>", f"</{t}>", f"<{t} class=x>"]))
            words.append(f"w{k}")
            parts.append(f" w{k} ")
        assert sorted(re.findall(r"w\d+", html.render("".join(parts)))) == sorted(words)
    df = spark.createDataFrame([(1, "<p>a", "z"), (1, "<p>a", "z"), (2, None, "z")], "page_id long, html string, text string")
    assert sorted((r.page_id, r.text) for r in html.extract_text(df).collect()) == [(1, "a"), (1, "a"), (2, "")]


def test_sketch_bound_keeps_links_at_the_threshold():
    rng = np.random.default_rng(8)
    for union in (20, 170, 900, 6000):
        common = int(np.ceil(0.85 * union))
        for _ in range(60):
            all_ = rng.choice(2**52, union, replace=False).astype(np.uint64)
            own = rng.integers(0, union - common + 1)
            a, b = np.sort(all_[: common + own]), np.sort(np.concatenate([all_[:common], all_[common + own :]]))
            x = neardup.long_sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            none = ((x[0] | x[1]) == 0).sum()
            assert (x[0] == x[1]).sum() - none >= neardup.least_common(len(a), len(b), neardup.LONG - none, 85)


def test_near_duplicates_of_named_ids_and_empty_table(spark):
    rows = [("x1", "a b c d"), ("x0", "a b c d"), ("x2", "p q r s")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [("x0", "x0", True), ("x1", "x0", False), ("x2", "x2", True)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(empty).count() == 0 and neardup.drop_near_duplicates(empty).count() == 0


def test_near_dedup_of_clashing_columns(spark):
    rows = [(1, "a b c d", 7, 8, "z"), (2, "a b c d", 7, 8, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, _id int, `_row` string")
    assert [tuple(r) for r in neardup.drop_near_duplicates(df).collect()] == [rows[0]]


def test_scorer_against_a_plain_version(monkeypatch):
    monkeypatch.setattr(weaklabel, "STEPS", 40)
    rng = random.Random(13)
    texts = [" ".join(rng.choice(["Alpha", "beta.", "GAMMA", "delta", "x%%", "12"]) for _ in range(rng.randrange(1, 40))) for _ in range(60)] + ["word " * 30000]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    index, count, first = weaklabel.counted(batch)
    label = [rng.random() for _ in texts]
    got = weaklabel.train([(index[a:b], count[a:b], y) for a, b, y in zip(first[:-1], first[1:], label, strict=True)])
    # the same steps on a plain matrix of feature shares
    feature, doc = weaklabel.features(batch)
    x = np.zeros((len(texts), 1 << weaklabel.BITS))
    np.add.at(x, (doc, feature), 1)
    x = np.hstack([weaklabel.SCALE * x / x.sum(1, keepdims=True), np.ones((len(texts), 1))])
    y = np.array(label)
    share = np.where(y >= 0.5, 0.5 / (y >= 0.5).sum(), 0.5 / (y < 0.5).sum())
    w, m, v = (np.zeros(x.shape[1]) for _ in range(3))
    for t in range(1, 41):
        g = x.T @ ((1 / (1 + np.exp(-x @ w)) - y) * share) + weaklabel.DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.05 * weaklabel.RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    assert np.abs(got - w).max() < 1e-6 and np.abs(w).max() > 0.1
    assert len(index[first[-2] :]) == 3


def test_weak_labels_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d."), (1, "a b c d."), (None, "a b c d."), (2, None)], "doc_id long, text string")
    rows = weaklabel.classify(df.selectExpr("*", "1 AS h", "2 AS score")).collect()
    assert len(rows) == 4 and len({r.score for r in rows if r.doc_id != 2}) == 1


def test_quality_rules_with_clashing_names_and_other_ids(spark):
    body = " ".join("abcdefghij"[k % 10] * (k // 10 + 1) for k in range(40))
    kind = "doc_id string, text string, source string, removed int, `a.b` string, _row int, whole int, n_chars int, lines string"
    rows = [(str(k) if k else "not a number", f"{body} {chr(97 + k % 26) * (9 + k // 26)}\nthe common line of all", "h", 1, "x", 2, 3, 9, "l") for k in range(30)]
    left = quality.apply_rules(spark.createDataFrame(rows, kind), min_docs=20)
    assert left.columns == ["doc_id", "text", "source", "removed", "a.b", "_row", "whole", "n_chars", "lines"]
    out = left.collect()
    assert len(out) == 30 and all(r.n_chars == len(r.text) and (r.removed, r["a.b"], r["_row"]) == (1, "x", 2) for r in out)
    assert sum("common line" in r.text for r in out) == 1
    empty = spark.createDataFrame([], kind)
    assert quality.apply_rules(empty).collect() == [] and quality.judge(empty).collect() == []


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.find_secrets(docs).collect() == [] and secrets.redact_secrets(docs).collect() == []
    assert html.extract_text(spark.createDataFrame([], "page_id long, html string")).collect() == []


def test_html_of_odd_attributes_deep_pages_and_wide_tables():
    nines = "5" * 5000
    assert html.render("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>") == "A  B\n   C"
    assert html.render("<table><tr><td colspan=2>long title<td>x<tr><td>a<td>b<td>c</table>") == "long title     x\na           b  c"
    assert html.render("<div>" * 5000 + "<div>alpha</div><div>beta</div>") == "alpha\nbeta"
    for start in ("²", "--5", nines, "", "x", "٣"):
        assert html.render(f'<ol start="{start}"><li>x') == "1. x"
    for odd in ('<td colspan="²">x', f"<td colspan={nines}>x", "<td colspan=-3 rowspan=0>x", "<td rowspan='--1'>x", f"<td rowspan={nines}>x"):
        assert html.render(odd) == "x"
    assert html.render(f"a&#{nines};b &#x{'f' * 4000};c &#65;") == "a�b �c A"
    assert html.render("<title>İİİİ</title><script>İ</SCRIPT>seen<ScRiPt>x</sCrIpT> too") == "seen too"
    rng = random.Random(31)
    tags = ["p", "div", "b", "li", "ul", "table", "tr", "td", "th", "span", "h2", "blockquote", "dd", "dt", "ol", "option", "tbody", "a", "i"]
    values = ["", "=1", "=0", "=-4", "=²", "='9999999999999'", '="3"', "=x", "=' '", "=1000", "=65534"]
    for _ in range(300):
        words, parts = [], []
        for k in range(40):
            t, a = rng.choice(tags), "".join(f" {n}{rng.choice(values)}" for n in ("colspan", "rowspan", "start") if rng.random() < 0.4)
            parts.append(rng.choice([f"<{t}{a}>", f"</{t}>", f"<{t}{a}>", "<br>", f"&#{rng.choice(values)};", "&amp;", f"<!--{t}-->"]))
            words.append(f"w{k}")
            parts.append(f" w{k} ")
        page = "".join(parts)
        out = html.render(page)
        assert sorted(re.findall(r"w\d+", out)) == sorted(words) and len(out) <= 60 * len(page)
    # time and output in proportion to the page
    for what in ("<a></b>", "<b>x<div>y</div>", "<table><tr><td rowspan=9>a", "<!a", "<blockquote>x", "<ul><li>a", "<td colspan=1000 rowspan=0>x<tr>", "<table><b><i></b>", "<p><b>", "<table><tr><td>a<td>b</table>"):
        took = []
        for n in (2000, 16000):
            began = time.process_time()
            out = html.render(what * n)
            took.append(time.process_time() - began)
            assert len(out) <= (html.WIDTH + html.INDENT) * len(what * n), what
        assert took[1] < 40 * max(took[0], 0.02), what
    page = "<table><tr><td>" + "x" * 20000 + "<td>y" + "<tr><td>a<td>b" * 2000 + "</table>"
    assert len(html.render(page)) <= 6 * len(page)


def test_a_long_path_costs_no_more_rounds_than_a_short_one(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(urls, "shared_checkpoint", lambda df, keep=urls.shared_checkpoint: rounds.append(1) or keep(df))
    pages = [("h.net", f"/a{k}/b/{'c/' * depth}d", "block") for k, depth in enumerate((1, 1000))] + [("h.org", "/x/" * 1000 + str(k), None) for k in range(4)]
    got = {r.path: (r.template, r.purity) for r in urls.templates(spark.createDataFrame(pages, "host string, path string, verdict string")).collect()}
    assert len(rounds) <= 7 and len(got) == 6
    want = brute.url_tree([p for p in pages if len(p[1]) < 900], urls)
    assert {t for p, (t, _) in got.items() if p.startswith("/x")} == {"h.org/**"} and len(want) == 1
    assert got["/a0/b/c/d"][0].startswith("h.net/{mix}") and got["/a1/b/" + "c/" * 1000 + "d"][0].count("/") == 1003


def test_url_tree_against_a_plain_one(spark):
    rng = random.Random(17)
    words = ["news", "blog", "item", "shop", "a", "b2", "x-1", "list.html", "view.php", "deadbeef01"]
    pages = []
    for _ in range(3000):
        host = rng.choice(["h1.net", "h2.net", "h3.net"])
        path = "".join("/" + (rng.choice(words) if rng.random() < 0.6 else str(rng.randrange(60)) + rng.choice(["", ".html"])) for _ in range(rng.randrange(0, 5)))
        bad = 0.9 if "/shop" in path else 0.1
        verdict = ("block" if rng.random() < bad else "allow") if rng.random() < 0.5 else None
        pages.append((host, path, verdict))
    got = urls.templates(spark.createDataFrame(pages, "host string, path string, verdict string")).collect()
    want = brute.url_tree(pages, urls)
    assert {(r.host, r.path): (r.template, r.labels) for r in got} == {k: (t, n) for k, (t, _, n) in want.items()}
    assert all(abs(r.purity - want[r.host, r.path][1]) < 1e-8 for r in got)
    assert any("+" in r.template for r in got) and any(r.purity >= urls.REJECT and r.labels >= urls.MIN_LABELS for r in got)


def plain_table(rows, width):
    """Lines of a table of words (lists of words for each cell), by the one rule: fold, measure, pad."""
    fold = lambda words: " ".join(words)
    cells = []
    for row in rows:
        out = []
        for k, words in enumerate(row):
            lines = [fold(words)] if words else []
            if k < len(row) - 1 and words and len(lines[0]) > width:
                lines, line = [], ""
                for w in words:
                    if line and len(line) + 1 + len(w) > width:
                        lines.append(line)
                        line = ""
                    line = f"{line} {w}" if line else w
                lines.append(line)
            out.append(lines)
        cells.append(out)
    widths = [max([len(x) for row in cells if k < len(row) - 1 for x in row[k] if len(x) <= width], default=0) for k in range(max(map(len, cells)))]
    shown = []
    for row in cells:
        for i in range(max(map(len, row))):
            line = ""
            for k, lines in enumerate(row):
                if i < len(lines):
                    place = sum(widths[:k]) + 2 * k
                    if line and place < len(line) + 2:
                        shown.append(line)
                        line = ""
                    line = line.ljust(place) + lines[i]
            shown.append(line)
    return "\n".join(x.rstrip() for x in shown)


def test_tables_against_a_plain_layout():
    rng = random.Random(41)
    for _ in range(300):
        rows = [[["x" * rng.choice([1, 3, 9, 20, 47, 48, 49, 70]) for _ in range(rng.choice([0, 1, 1, 2, 9]))] for _ in range(rng.randrange(1, 5))] for _ in range(rng.randrange(1, 6))]
        page = "<table>" + "".join("<tr>" + "".join(f"<td>{' '.join(c)}</td>" for c in row) for row in rows) + "</table>"
        assert html.render(page) == plain_table(rows, html.WIDTH), page
    wide = html.render("<table>" + "".join(f"<tr><td>name{k}<td>{k}" for k in range(6)) + f"<tr><td>{'y' * 400}<td>6</table>").split("\n")
    assert [x.index(str(k)) for k, x in enumerate(wide[:6]) if k] == [4] * 5 and wide[3] == "name3  3" and wide[6:] == ["y" * 400, "       6"]


def test_random_spans_against_a_plain_version():
    rng = random.Random(23)
    word = lambda: rng.choice(["the", "information", "=", "key=", " ", "\n", "/", "https://example.com/a_b/", "?sig=", "john@mail.example.com", HEXES[:40], HEXES, KEY, "token: " + HEXES[:12], "20240101120000123456", "é", "-", "123e4567-e89b-12d3-a456-426614174000", "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.choice([5, 12, 24, 40])))])
    for _ in range(400):
        text = "".join(word() for _ in range(rng.randrange(1, 14)))
        base = secrets.base_spans(text)
        free = [re.fullmatch(r"[A-Za-z0-9+/_=-]", c) is not None for c in text]
        taken = [s[1:] for s in base] + [m.span() for m in secrets.KNOWN.finditer(text)]
        for m in re.finditer(r"""://(?:[^\s/?#@"'<>]*@)?""", text):  # slashes of a url up to its query part runs
            at = m.end()
            while at < len(text) and text[at] not in "?#\"'<>" and not text[at].isspace():
                taken += [(at, at + 1)] * (text[at] == "/")
                at += 1
        for i, j in taken:
            free[i:j] = [False] * (j - i)
        want, at = [], 0
        while at < len(text):
            end = at
            while end < len(text) and free[end]:
                end += 1
            if end - at >= secrets.MIN_CHARS:
                if secrets.is_random(text[at:end]):
                    want.append((3, at, end))
                else:
                    cuts = [at, *(k for k in range(at + 1, end) if text[k - 1] == "=" and text[k] != "="), end]
                    want += [(3, i, j) for i, j in zip(cuts, cuts[1:]) if len(cuts) > 2 and j - i >= secrets.MIN_CHARS and secrets.is_random(text[i:j])]
            at = max(end, at + 1)
        assert sorted(s for s in secrets.all_spans(text) if s[0] == 3) == want and [s for s in secrets.all_spans(text) if s[0] < 3] == base


def test_encoder_starts_anew_when_its_cache_is_full(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 200)
    monkeypatch.setattr(packing, "POOL", 300)
    encoder = packing.Encoder()
    for seed in range(4):
        texts = [t or "" for _, t in corpus(seed, 20)]
        ids, first = encoder.column(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]))
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [encoder.encode(t).tolist() for t in texts]
