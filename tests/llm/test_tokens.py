"""Operators 11 to 13 against plain versions: the tokenizers' own libraries, all pairs of tokens, and all pairs of vectors."""

import bisect
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from lexloom.llm import alignment, bpe, negatives, queries

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ATOMS = ["'", "'s", "'re", "'ll", " ", "  ", "\n", "\t", "\r\n", "a", "B", "é", "1", "٣", "ß", "日本", "🙂", " ", "　", " ", "<|endoftext|>", "<|endof", "text|>", "!", "…", "’", "T", "ing",
         "́", "\x00", "\x1c", "\x85", "ǅ", "²", "''t", "don't", "I'LL", "👨‍👩", "word", " the", " of", "<s>", "</s>", "<unk>", "▁", "<0x41>"]
ODD = [None, "", " ", "  \n", "one", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "a" * 3000, " " * 2000, "\n " * 500, "日" * 1500, "'s" * 50, "word " * 30000]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(13)
    made = ["".join(rng.choice(ATOMS) for _ in range(rng.randrange(0, 30))) for _ in range(300)]
    far = "".join(chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0xE000, 0x30000)])) for _ in range(8000))
    return [*enumerate([*made, far, *ODD, made[0], made[0]])]


@pytest.fixture(scope="module")
def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 7, [1]) for i, t in texts], "doc_id long, text string, ids string, row long, a array<int>").repartition(3).cache()


def tokenizer(plain=False):
    t = Tokenizer.from_file(BYTES)
    t.encode_special_tokens = plain
    return t


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_encoding_is_the_librarys(frame, texts):
    for special in (True, False):
        library = tokenizer(not special)
        got = {r.doc_id: r for r in bpe.encode(frame, special=special, decoded=True).collect()}
        for i, t in texts:
            want = library.encode(t or "", add_special_tokens=False).ids
            assert ids_of(got[i].ids) == want and got[i].n_tokens == len(want), repr(t)[:80]
            assert got[i].decoded == library.decode(want, skip_special_tokens=False) == (t or "")


def test_every_cut_is_one_that_no_token_crosses():
    words = bpe.vocabulary(None)
    data = np.frombuffer("it's  a\n\nlong-ish naïve text".encode(), np.uint8)
    begin, end, _, _ = bpe.Encoder(words, bpe.class_runs()).fragments(data, np.array([0, len(data)]))
    assert begin[0] == 0 and (begin[1:] == end[:-1]).all() and end[-1] == len(data)
    forced = np.flatnonzero(words.never[data[:-1].astype(int) << 8 | data[1:]]) + 1
    assert len(forced) and set(forced) <= set(begin)


def test_fragments_do_not_depend_on_the_cache(monkeypatch, texts):
    want = tokenizer()
    monkeypatch.setattr(bpe, "CACHE", 5)
    monkeypatch.setattr(bpe, "POOL", 5)
    encoder = bpe.Encoder(bpe.vocabulary(None), bpe.class_runs())
    for k in range(0, 80, 20):
        some = [t or "" for _, t in texts[k : k + 20]]
        ids, first = encoder.column(*bpe.string_bytes(pa.array(some)))
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [want.encode(t, add_special_tokens=False).ids for t in some]


def test_decoding_of_any_ids(spark):
    rng, library = random.Random(3), tokenizer()
    made = [[rng.randrange(50257) for _ in range(rng.randrange(0, 9))] for _ in range(400)] + [None, [50256, 0, 50256], [60000, 5, 70000]]
    rows = spark.createDataFrame([(k, None if x is None else np.array(x, "<u4").tobytes()) for k, x in enumerate(made)], "k int, ids binary")
    got = {r.k: r.decoded for r in bpe.decode(rows).collect()}
    assert got == {k: library.decode([i for i in x or [] if i < 50257], skip_special_tokens=False) for k, x in enumerate(made)}


def test_op13_digests(spark, tmp_path, texts):
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    library, got = tokenizer(), {r.doc_id: r for r in queries.op13_bpe_round_trip(spark, str(tmp_path)).collect()}
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i][1:] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def plain_alignment(texts):
    """{id: (n_a, n_b, n_groups, n_links, n_best, count_sum, groups)}, from all pairs of tokens."""
    a_side, b_side = tokenizer(True), SentencePieceProcessor(model_file=PIECES)
    back = bpe.vocabulary(None)
    one, counts = {}, Counter()
    for i, t in texts:
        ids = (a_side.encode(" " + t, add_special_tokens=False).ids, b_side.encode(t)) if t else ([], [])
        raw = [[bytes(back.bytes[back.starts[x] : back.starts[x] + back.lengths[x]]) for x in ids[0]], [bytes([int(p[3:5], 16)]) if b_side.is_byte(x) else p.replace("▁", " ").encode() for x in ids[1] for p in [b_side.id_to_piece(x)]]]
        if any(b"".join(x) != (" " + (t or "")).encode() for x in raw):
            ids, raw = ([], []), [[], []]
        spans = [[(end - len(x), end) for x, end in zip(side, np.cumsum([len(x) for x in side]).tolist(), strict=True)] for side in raw]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = [[[], []] for _ in cuts]
        for side in (0, 1):
            for x, (_, e) in zip(ids[side], spans[side], strict=True):
                groups[bisect.bisect_left(cuts, e)][side].append(x)
        links = Counter()
        at = 0
        for x, (s, e) in zip(ids[0], spans[0], strict=True):
            while at < len(spans[1]) and spans[1][at][1] <= s:
                at += 1
            k = at
            while k < len(spans[1]) and spans[1][k][0] < e:
                links[x, ids[1][k]] += 1
                k += 1
        one[i] = (ids, groups, links)
        counts += links
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    text = lambda groups: ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
    return {
        i: (len(ids[0]), len(ids[1]), len(groups), sum(links.values()), sum(n for p, n in links.items() if counts[p] == most[p[1]]), sum(n * counts[p] for p, n in links.items()), text(groups))
        for i, (ids, groups, links) in one.items()
    }


@pytest.fixture(scope="module")
def aligned(texts):
    return plain_alignment(texts)


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 40, 0])
def test_alignment(frame, texts, aligned, frequent):
    want = aligned
    got = {r.doc_id: r for r in alignment.alignment_digests(frame, frequent=frequent).collect()}
    assert len(got) == len(texts)
    for i, w in want.items():
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == w[:6], repr(texts[i][1])[:80]
        assert got[i].groups_sha256 == (hashlib.sha256(w[6].encode()).hexdigest() if w[0] else "")


def test_alignment_keeps_groups_and_pairs(frame, aligned):
    want = aligned
    rows = alignment.align(frame).collect()
    assert {r.doc_id: r.groups for r in rows} == {i: w[6] for i, w in want.items()}
    assert sum(sum(r.n) for r in rows) == sum(w[3] for w in want.values())


def test_bits():
    rng = np.random.default_rng(2)
    at, other = (np.flatnonzero(rng.random(1000) < 0.3) for _ in range(2))
    bits = alignment.Bits(at, 1000)
    assert (bits & alignment.Bits(other, 1000)).select().tolist() == sorted(set(at.tolist()) & set(other.tolist()))
    places = np.arange(1000)
    assert bits.rank(places).tolist() == [(at < p).sum() for p in places]


def plain_negatives(rows, every=100, positives=5, most=10):
    """All scores, one by one; rows: (id, label, vector) with distinct ids."""
    good = {i: (label, [int(np.floor(256 * x)) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for a, (label, v) in good.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(v, w, strict=False)) for i, (_, w) in good.items() if i != a}
        first = lambda ids: sorted(ids, key=lambda i: (-score[i], i))  # noqa: E731, B023
        for p in first(i for i in score if good[i][0] == label)[:positives]:
            inside = [i for i in score if good[i][0] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(first(inside)[:most])]
    return sorted(out)


def vectors(n, seed=4, width=20, whole=False):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(3), [float(rng.randrange(-2, 3)) if whole else rng.gauss(0, 0.3) for _ in range(width)]) for i in range(n)]
    return rows + [(n, None, rows[0][2]), (n + 1, 1, None), (n + 2, 1, [None] * width), (n + 3, 2, [float("nan")] * width), (n + 4, 0, [float("inf")] * width), (n + 5, 1, []), (n + 6, 2, [0.5] * 3), (None, 1, rows[0][2])]


@pytest.mark.parametrize("whole", [False, True])
def test_hard_negatives(spark, whole):
    rows = vectors(420, whole=whole)  # whole numbers make many ties
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, label int, embedding array<double>, v string")
    want = plain_negatives(rows, every=20)
    assert want
    for sizes in ({}, {"block": 50, "anchor_block": 7, "chunk": 6}):
        assert sorted(map(tuple, negatives.mine(frame, every=20, **sizes).collect())) == want
    assert sorted(map(tuple, negatives.mine(frame.union(frame), every=20, block=64).collect())) == want


def test_hard_negatives_of_few_rows(spark):
    schema = "vec_id long, label int, embedding array<float>"
    for rows in ([], [(0, 1, [1.0])], [(0, 1, [1.0]), (1, 1, [0.5])], [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.5])], [(0, 1, [-1.0]), (1, 1, [1.0]), (2, 2, [0.5])]):
        assert sorted(map(tuple, negatives.mine(spark.createDataFrame(rows, schema)).collect())) == plain_negatives(rows)


def test_products_beyond_doubles_stay_exact():
    a = np.array([[2**40 + 1, -(2**39) - 3]])
    assert negatives.product(a, np.array([[2**20 + 1, 7]])).tolist() == [[(2**40 + 1) * (2**20 + 1) - 7 * (2**39 + 3)]]
    for top in (5, 300, 2**20, 2**40):
        tile = np.random.default_rng(top).integers(-top, top, (3, 50))
        assert (negatives.unpacked_tile(negatives.packed_tile(tile), tile.shape) == tile).all()


def test_large_components_saturate(spark):
    rows = spark.createDataFrame([(0, 1, [1e300]), (1, 1, [-1e300])], "vec_id long, label int, embedding array<double>")
    assert sorted(r.v[0] for r in negatives.usable(rows, F.col("label")).collect()) == [-negatives.LARGEST, negatives.LARGEST]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(none, decoded=True).count() == 0 and alignment.alignment_digests(none).count() == 0
