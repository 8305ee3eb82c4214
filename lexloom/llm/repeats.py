"""Operator 4, substring dedup: level-wise doubling.

A window is `length` consecutive words of one document. A word goes if any
window that covers it has a word sequence that starts at another place too, in
the same document or another.

Levels. The first level looks at short windows of `base` words, each next one
at windows of twice that length, the last at `length` itself. On every level a
full window is represented by the one short window inside it with the least
hash, so equal full windows have equal representatives, and only about two in
`length - base` short windows need to be exchanged. Representatives that occur
once are dropped with their full windows. If all places of a representative
also agree in the whole stretch of text for which it stands, those windows
are repeated and done. Only the rest is extended to twice the length; the loop
ends when no candidate survives.

Exchanged are hashes and keys, grouped by a partial aggregate and an
equi-join that Spark can split, so neither one frequent passage nor one source
lands in one task. Texts are exchanged by key: once for the result, once for each
level after the first.

Defined cases: null text is empty; documents of fewer than `length` words stay
whole; rows repeated with the same id and text are each an occurrence; extra
columns are ignored; an empty table gives an empty result. Words are compared
by 64-bit hashes of their sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, Polynomial, Words, keyed, shared_checkpoint, signed, slices, squeezed, take, unsqueezed, words_of

LENGTH = 35
BASE = 18


def levels(length: int, base: int) -> list[int]:
    """Window lengths: base, doubled until length is reached."""
    out = [min(base, length)]
    while out[-1] < length:
        out.append(min(2 * out[-1], length))
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values the place of the least, the first of equals."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, reach = np.arange(len(values)), 1
    while reach < width:
        step = min(reach, width - reach)
        a, b = at[:-step], at[step:]
        at = np.where(values[b] < values[a], b, a)
        reach += step
    return at[:n]


class _Stretches:
    """The full windows of some documents, in runs with a common representative.

    hash: of the representative; context: of all words of the run's windows;
    low, high: the first and last window of the run.
    """

    def __init__(self, words: Words, size: int, length: int, alive: np.ndarray | None):
        poly = Polynomial(words.hash)
        grams = poly.windows(size)
        least = _least(grams, length - size + 1)
        fits = words.room()[: len(least)] >= length
        if alive is not None:
            fits &= alive[: len(least)]
        full = np.flatnonzero(fits)
        at = least[full]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (full[1:] != full[:-1] + 1)
        cut = np.flatnonzero(new)
        self.low = full[cut]
        self.high = full[np.append(cut[1:], len(full)) - 1] if len(full) else self.low
        self.hash = grams[at[cut]]
        self.context = poly.hashes(self.low, self.high + length)
        self.doc = np.searchsorted(words.first, self.low, "right") - 1


def _spread(low: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """True from each low up to, not with, its end."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, low, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:n]) > 0


def _replay(batch: pa.RecordBatch, words: Words, sizes: list[int], length: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Windows known to be repeated, and windows still open, after the levels in `sizes`."""
    n = int(words.first[-1])
    done, alive = np.zeros(n, bool), None
    verdicts = batch.column("verdicts").to_pylist() if "verdicts" in batch.schema.names else []
    for k, size in enumerate(sizes):
        runs = _Stretches(words, size, length, alive)
        state = np.zeros(len(runs.low), np.int8)
        bounds = np.searchsorted(runs.doc, np.arange(len(words.count) + 1))
        for d, lists in enumerate(verdicts):
            for v in lists or ():
                if v["level"] == k and bounds[d + 1] > bounds[d]:
                    own = runs.hash[bounds[d] : bounds[d + 1]].view(np.int64)
                    for name, mark in (("settled", 1), ("open", 2)):
                        if v[name]:
                            state[bounds[d] : bounds[d + 1]][np.isin(own, np.array(v[name], np.int64))] = mark
        done |= _spread(runs.low[state == 1], runs.high[state == 1] + 1, n)
        alive = _spread(runs.low[state == 2], runs.high[state == 2] + 1, n)
    return done, alive


def _emit(size: int, before: list[int], length: int):
    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in unsqueezed(batches) for s in slices(b)):
            words = words_of(batch)
            _, alive = _replay(batch, words, before, length) if before else (None, None)
            runs = _Stretches(words, size, length, alive)
            # one row for each representative of a document
            order = np.lexsort((runs.context, runs.hash, runs.doc))
            h, doc, context = runs.hash[order], runs.doc[order], runs.context[order].view(np.int64)
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(h)))
            low, high = (f.reduceat(context, first) if len(h) else context for f in (np.minimum, np.maximum))
            yield pa.RecordBatch.from_arrays([signed(h[first]), pa.array(n), pa.array(low), pa.array(high), *take(batch, KEY, doc[first])], ["h", "n", "a", "b", *KEY])

    return stretches


def _clean(sizes: list[int], length: int):
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in unsqueezed(batches) for s in slices(b)):
            words = words_of(batch)
            done, _ = _replay(batch, words, sizes, length)
            start = np.flatnonzero(done)
            gone = _spread(start, start + length, int(words.first[-1]))
            raw, texts, removed = words.data.tobytes(), [], []
            for d in range(len(words.count)):
                a, b = words.first[d], words.first[d + 1]
                own = gone[a:b]
                removed.append(int(own.sum()))
                texts.append(b" ".join(raw[i:j] for i, j in zip(words.start[a:b][~own], words.end[a:b][~own], strict=True)) if own.any() else b" ".join(raw[words.bytes[d] : words.bytes[d + 1]].split()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words.count), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return kept


def remove_repeats(docs: DataFrame, length: int = LENGTH, base: int = BASE) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by one space) for each row of docs."""
    rows = keyed(docs)
    key_type = "_id long, _t long"
    sizes, parts = levels(length, base), []
    texts, candidates = squeezed(rows), rows.select(*KEY, "text")
    for k, size in enumerate(sizes):
        found = candidates.mapInArrow(_emit(size, sizes[:k], length), f"h long, n long, a long, b long, {key_type}")
        judged = (
            found.groupBy("h")
            .agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b"))
            .where("n > 1")
            .select(F.expr("h ^ 1").alias("k"), "h", (F.col("a") != F.col("b")).alias("open"))
        )
        # joined by another key than judged is grouped by, so that both sides are exchanged and Spark can split a hot one
        mine = (
            found.select(F.expr("h ^ 1").alias("k"), *KEY)
            .join(judged, "k")
            .groupBy(*KEY)
            .agg(F.collect_set(F.expr("if(open, null, h)")).alias("settled"), F.collect_set(F.expr("if(open, h, null)")).alias("open"))
        )
        parts.append(shared_checkpoint(mine.withColumn("level", F.lit(k))))
        if k + 1 == len(sizes) or parts[-1].where(F.size("open") > 0).isEmpty():
            break
        so_far = _verdicts(parts)
        going = parts[-1].where(F.size("open") > 0).select(*KEY)
        candidates = texts.select(*KEY, "text").join(so_far.join(going, KEY), KEY)
    return texts.join(_verdicts(parts), KEY, "left").select("doc_id", "text", "verdicts").mapInArrow(
        _clean(sizes[: len(parts)], length), f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, n_removed long, kept_text string"
    )


def _verdicts(parts: list[DataFrame]) -> DataFrame:
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy(*KEY).agg(F.collect_list(F.struct("level", "settled", "open")).alias("verdicts"))
