"""Operator 2, quality rules: cross-document line frequency.

Lines (split at newlines, normalised: A-Z lower-cased, digits alike, blanks between
words alike) are hashed. For each host, here the column `source`, the distinct documents
that have a line are counted, copies of a text each, against the host's distinct documents. A
line above the limits (MIN_DOCS documents and SHARE of the host's) is removed
wherever it is not its first document's on that host, and a document is
rejected if less than KEEP of its words or fewer than MIN_WORDS are left. The base
figures reject too short and too repetitive documents, see `base_failed`.

The line counts group by (host, line) after a partial aggregate; the way back
to documents is an equi-join. A document sends each distinct line once, so a
hot host or line makes rows in proportion to its documents and no more.

Defined cases: null text is empty and fails the base rules; a null host is a
host of its own; wordless lines are never counted or removed; a line twice in
one document counts once and goes or stays as a whole; repeated rows with the same id
and text share one verdict and count once; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _FOLDED, BLANK, KEY, Polynomial, _byte_powers, carried, keyed, partitions, ragged, renewed, shared_checkpoint, slices, words_of

MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
MIN_DOCS, SHARE, KEEP = 20, 0.005, 0.5

_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_ALIKE = _FOLDED.copy()
_ALIKE[48:58] = _FOLDED[48]


def _within(total: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of 0/1 values between edges."""
    sums = np.concatenate([[0], np.cumsum(total)])
    return sums[edges[1:]] - sums[edges[:-1]]


def _again(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values have an equal in the same document, and which of them are not the first."""
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    same = (d[1:] == d[:-1]) & (h[1:] == h[:-1])
    shared, later = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
    shared[order[1:][same]] = shared[order[:-1][same]] = True
    later[order[1:][same]] = True
    return shared, later


class LineView:
    """The lines with words of a slice: their document, first and last word, raw and normalised hash."""

    def __init__(self, batch: pa.RecordBatch):
        self.words = words = words_of(batch)
        lines = words_of(batch, blank=_NEWLINE)
        a, b = np.searchsorted(words.start, lines.start), np.searchsorted(words.start, lines.end)
        full = a < b
        self.low, self.high, self.start, self.end = a[full], b[full], lines.start[full], lines.end[full]
        self.doc = lines.doc()[full]
        self.raw = words.poly.hashes(self.start, self.end)
        alike = Polynomial(_ALIKE[words.data], _byte_powers).hashes(words.start, words.end)
        self.alike = Polynomial(alike).hashes(self.low, self.high)


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (s for b in batches for s in slices(b)):
        view = LineView(batch)
        words, n = view.words, batch.num_rows
        grams = Polynomial(words.hash).windows(WINDOW)
        at = np.flatnonzero(words.room()[: len(grams)] >= WINDOW)
        shared, _ = _again(np.searchsorted(words.first, at, "right") - 1, grams[at])
        edge = np.zeros(int(words.first[-1]) + 1, np.int64)
        np.add.at(edge, at[shared], 1)
        np.add.at(edge, at[shared] + WINDOW, -1)
        covered = np.cumsum(edge[:-1]) > 0
        _, later = _again(view.doc, view.raw)
        head = ((words.data & 0xC0) != 0x80) & ~BLANK[words.data]
        _, twice = _again(view.doc, view.alike)
        size = np.bincount(view.doc, minlength=n)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("source"), *(batch.column(k) for k in KEY), pa.array(words.count),
             pa.array(_within(head, words.bytes)), pa.array(_within(_SYMBOL[words.data], words.bytes)),
             pa.array(np.bincount(view.doc[later], minlength=n)), pa.array(_within(covered, words.first)),
             ragged(view.alike.view(np.int64), size), ragged((view.high - view.low).astype(np.int64), size)],
            ["doc_id", "source", *KEY, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words"],
        )


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines whose hashes are in `removed`."""
    for batch in (s for b in batches for s in slices(b)):
        view = LineView(batch)
        bounds = np.searchsorted(view.doc, np.arange(batch.num_rows + 1))
        raw, texts = view.words.data.tobytes(), batch.column("text").to_pylist()
        for d, gone in enumerate(batch.column("removed").to_pylist()):
            if gone:
                own = slice(bounds[d], bounds[d + 1])
                drop = np.isin(view.alike[own].view(np.int64), np.array(gone, np.int64))
                at, out = int(view.words.bytes[d]), []
                for i, j in zip(view.start[own][drop], view.end[own][drop], strict=True):
                    out.append(raw[at:i])
                    at = min(int(j) + 1, int(view.words.bytes[d + 1]))
                texts[d] = b"".join([*out, raw[at : view.words.bytes[d + 1]]]).decode()
        yield batch.drop_columns(["removed", "text"]).append_column("text", pa.array(texts, pa.string()))


def judge(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, keep: float = KEEP) -> DataFrame:
    """For each row: doc_id, its key, the base figures, base_failed, n_removed_words, removed (hashes of lines) and kept."""
    rows = keyed(docs, F.col("source").cast("string").alias("source"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    figures = rows.mapInArrow(_figures, f"doc_id {kind}, source string, _id long, _t long, {counts}, lines array<long>, line_words array<long>")
    figures = shared_checkpoint(figures.withColumn("lines", F.arrays_zip("lines", "line_words")).drop("line_words").repartition(partitions(docs.sparkSession), *KEY))

    # a document is an id and a text; only repeated rows of both count once
    lines = figures.select("source", *KEY, F.explode(F.array_distinct("lines.lines")).alias("line"))
    often = lines.distinct().groupBy("source", "line").agg(F.count("*").alias("n"), F.min(F.struct("_id", "_t")).alias("first")).where(F.col("n") >= min_docs)
    hosts = figures.select("source", *KEY).distinct().groupBy("source").agg(F.count("*").alias("docs"))
    often = often.toDF("host", "often", "n", "first").join(hosts, F.col("host").eqNullSafe(F.col("source"))).where(F.col("n") >= share * F.col("docs")).select("host", "often", "first")
    gone = lines.join(often, (F.col("line") == F.col("often")) & F.col("source").eqNullSafe(F.col("host"))).where(F.struct("_id", "_t") != F.col("first"))
    gone = gone.groupBy(*KEY).agg(F.collect_set("line").alias("removed"))

    out = figures.join(gone, KEY, "left")
    lost = F.aggregate(F.filter("lines", lambda x: F.array_contains("removed", x["lines"])), F.lit(0).cast("long"), lambda n, x: n + x["line_words"])
    out = out.withColumn("n_removed_words", F.when(F.col("removed").isNull(), F.lit(0).cast("long")).otherwise(lost))
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
    left = F.col("n_words") - F.col("n_removed_words")
    out = out.withColumn("kept", ~F.col("base_failed") & (left >= MIN_WORDS) & (left >= keep * F.col("n_words")))
    return out.drop("lines", "source")


def apply_rules(docs: DataFrame, **limits) -> DataFrame:
    """The documents that pass, without the lines above the limits; n_chars follows the text. Columns as in docs."""
    verdicts = judge(docs, **limits).where("kept").select(*KEY, "removed").dropDuplicates(KEY)
    # of a kept document the text is never null; it travels once
    kept = carried(docs).join(verdicts, KEY).select(F.col("_row").dropFields("text").alias("_row"), F.col("_row")["text"].alias("text"), "removed")
    return renewed(docs, kept.mapInArrow(_without, kept.select("_row", "text").schema))
