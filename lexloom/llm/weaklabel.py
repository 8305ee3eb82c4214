"""Operator 9, quality classifier: a weak-label model and a hashed linear scorer.

Overlapping heuristic labellers vote good, bad or nothing on each document. Their votes are
counted by pattern over the whole corpus (at most 3**labellers rows), and
expectation-maximisation on these counts estimates how often each labeller is
right, and with it a posterior for each pattern. SAMPLE distinct texts, the ones
with the least hashes, then train a logistic scorer on hashed features of
words, endings and shapes, with the posteriors as labels. The scorer alone scores
every document, in one pass with no exchange.

The sample is cut by hashes alone: distinct hashes are counted, those below the threshold that
leaves a few more than SAMPLE are sorted, and only then are their texts read.
Bounds: the pattern table, SAMPLE texts with 1 << BITS features at most, however long they are, and
1 << BITS weights sent to executors.

Defined cases: null, empty and wordless texts score 0 and are not kept;
where all patterns agree the posterior is that of the prior; repeated rows score
alike, equal texts train once; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK, Polynomial, U, _byte_powers, mix, ragged, shared_checkpoint, slices, words_of
from .quality import _SYMBOL, WINDOW, LineView, _again, _within

LABELLERS = ("length", "symbols", "capitals", "repeated_lines", "repeated_words", "exclamations", "line_ends", "word_length", "bare_marks", "marked_words", "marks")
#: For each labeller its figure is bad from the first limit on and good up to the second; length and line_ends the other way round.
LIMITS = ((20, 50), (0.1, 0.02), (0.3, 0.12), (0.3, 0.0), (0.2, 0.05), (0.1, 0.02), (0.1, 0.5), (12.0, 9.0), (0.15, 0.05), (0.2, 0.05), (0.6, 0.3))
FALLING = (0, 6)
SAMPLE, BITS = 8000, 14
STEPS, RATE, DECAY, SCALE = 300, 2.0, 1e-4, 8.0
KEEP = 0.5

_UPPER, _LETTER, _END = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_END[list(b".!?;:\"')")] = True
_CLASS = np.arange(1, 257, dtype=np.uint64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = U(1001), U(1002), U(1003), U(1001)


def votes(batch: pa.RecordBatch) -> np.ndarray:
    """1 good, 2 bad, 0 nothing: a row per document, a column per labeller."""
    view = LineView(batch)
    words, n = view.words, batch.num_rows
    count = np.maximum(words.count, 1)
    grams = Polynomial(words.hash).windows(WINDOW)
    at = np.flatnonzero(words.room()[: len(grams)] >= WINDOW)
    doc = np.searchsorted(words.first, at, "right") - 1
    _, again = _again(doc, grams[at])
    _, later = _again(view.doc, view.raw)
    lines = np.maximum(np.bincount(view.doc, minlength=n), 1)
    data = words.data
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    bare = letters[words.end] == letters[words.start]
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    marked = symbols[words.end] > symbols[words.start]
    ends = _END[data[words.end[view.high - 1] - 1]] if len(view.high) else np.zeros(0, bool)
    figures = (
        words.count,
        _within(_SYMBOL[data], words.bytes) / count,
        _within(_UPPER[data], words.bytes) / np.maximum(_within(_LETTER[data], words.bytes), 1),
        np.bincount(view.doc[later], minlength=n) / lines,
        np.bincount(doc[again], minlength=n) / count,
        _within(data == 33, words.bytes) / count,
        np.bincount(view.doc[ends], minlength=n) / lines,
        _within(_LETTER[data], words.bytes) / count,
        np.bincount(words.doc()[bare], minlength=n) / count,
        np.bincount(words.doc()[marked], minlength=n) / count,
        _within(~_LETTER[data] & ~BLANK[data], words.bytes) / count,
    )
    out = np.zeros((n, len(LABELLERS)), np.int8)
    for k, (f, (bad, good)) in enumerate(zip(figures, LIMITS, strict=True)):
        low = k in FALLING
        out[:, k] = np.where(f <= bad if low else f >= bad, 2, np.where(f >= good if low else f <= good, 1, 0))
    return out


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """EM on vote patterns: the posterior of good for each, P(vote | class) as (class, labeller, vote), and the prior."""
    good, bad = (patterns == 1).sum(1), (patterns == 2).sum(1)
    post = (good + 1) / (good + 2 * bad + 2)
    table, prior = np.zeros((2, patterns.shape[1], 3)), 0.5
    for _ in range(rounds):
        for c, weight in enumerate((counts * (1 - post), counts * post)):
            for v in range(3):
                table[c, :, v] = ((patterns == v) * weight[:, None]).sum(0) + 0.5
            table[c] /= table[c].sum(1, keepdims=True)
        prior = float(((counts * post).sum() + 1) / (counts.sum() + 2))
        log = [np.log(p) + np.log(table[c][np.arange(patterns.shape[1]), patterns]).sum(1) for c, p in ((0, 1 - prior), (1, prior))]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post, table, prior


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words, three each, and the document of each."""
    words = words_of(batch, fold=True)
    tail = np.maximum(words.start, words.end - 3)
    shape = Polynomial(_CLASS[words.data], _byte_powers)
    first = shape.hashes(words.start, words.start + 1)
    kinds = [words.hash, words.poly.hashes(tail, words.end) + U(1), mix(first + U(3) * shape.hashes(tail, words.end))]
    return np.concatenate([(k >> U(64 - BITS)).astype(np.int64) for k in kinds]), np.tile(words.doc(), 3)


def counted(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct features of each document, by document, how often it has each, and where each document's begin."""
    index, doc = features(batch)
    both, count = np.unique((doc.astype(np.int64) << BITS) | index, return_counts=True)
    return (both & ((1 << BITS) - 1)).astype(np.int32), count.astype(np.int32), np.searchsorted(both, np.arange(batch.num_rows + 1) << BITS)


def train(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """Weights, the bias last, from each document's distinct features, their counts, and its posterior."""
    size = 1 << BITS
    weights = np.zeros(size + 1)
    if not rows:
        return weights
    index = np.concatenate([f for f, _, _ in rows])
    doc = np.repeat(np.arange(len(rows)), [len(f) for f, _, _ in rows])
    times = np.concatenate([n for _, n, _ in rows])
    value = SCALE * times / np.maximum(np.bincount(doc, weights=times, minlength=len(rows)), 1)[doc]
    y = np.array([p for _, _, p in rows])
    # both classes weigh the same
    weight = np.where(y >= 0.5, 0.5 / max(1, (y >= 0.5).sum()), 0.5 / max(1, (y < 0.5).sum()))
    speed, seen = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(doc, weights=weights[index] * value, minlength=len(rows)) + weights[-1]
        slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        grad = np.append(np.bincount(index, weights=slope[doc] * value, minlength=size), slope.sum()) + DECAY * weights
        speed, seen = 0.9 * speed + 0.1 * grad, 0.99 * seen + 0.01 * grad * grad
        weights -= 0.05 * RATE * (speed / (1 - 0.9**step)) / (np.sqrt(seen / (1 - 0.99**step)) + 1e-9)
    return weights


def classify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score and kept for each row of docs."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            found, count = np.unique(votes(batch), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(["".join(map(str, r)) for r in found.tolist()]), pa.array(count.astype(np.int64))], ["pattern", "n"])

    table = rows.where(F.length("text") > 0).select("text").mapInArrow(patterns, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    table = [r for r in table if len(r.pattern) == len(LABELLERS)]
    posterior: dict[str, float] = {}
    if table:
        post, _, _ = estimate(np.array([list(map(int, r.pattern)) for r in table]), np.array([r.n for r in table], float))
        posterior = {r.pattern: float(p) for r, p in zip(table, post, strict=True)}

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            index, count, first = counted(batch)
            label = [posterior["".join(map(str, v))] for v in votes(batch).tolist()]
            size = np.diff(first)
            yield pa.RecordBatch.from_arrays([batch.column("h"), ragged(index, size), ragged(count, size), pa.array(label)], ["h", "index", "times", "label"])

    hashed = rows.where(F.length("text") > 0).select(F.xxhash64("text").alias("h"), "text")
    distinct = shared_checkpoint(hashed.select("h").distinct())
    share = (sample + 8 * sample**0.5 + 20) / max(1, distinct.count())
    if share < 1:  # hashes are even, so below this one lie a few more than needed
        distinct = distinct.where(F.col("h") < int(share * 2**64) - 2**63)
    least = distinct.orderBy("h").limit(sample)
    chosen = hashed.join(F.broadcast(least), "h").dropDuplicates(["h"])
    found = chosen.mapInArrow(sampled, "h long, index array<int>, times array<int>, label double").toArrow()
    learned = sorted(zip(*(found.column(c).to_pylist() for c in ("h", "label")), range(found.num_rows), strict=True))
    lists = [[x.values.to_numpy() for x in found.column(c)] for c in ("index", "times")]
    weights = spark.sparkContext.broadcast(train([(lists[0][k], lists[1][k], label) for _, label, k in learned]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in (s for b in batches for s in slices(b)):
            index, doc = features(batch)
            count = np.bincount(doc, minlength=batch.num_rows)
            z = SCALE * np.bincount(doc, weights=w[index], minlength=batch.num_rows) / np.maximum(count, 1) + w[-1]
            score = np.where(count > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scored, f"doc_id {kind}, score double").withColumn("kept", F.col("score") >= KEEP)
