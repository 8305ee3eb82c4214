"""Operator 6, toxicity: nearest labelled examples by exact TF-IDF cosine.

Examples are labelled rows, at most EXAMPLES of each label, the ones with the least text
hashes; equal texts count once. Terms are all lower-cased words of the examples
(runs of letters), and those of their beginnings (of STEMS bytes, so that inflected forms meet) and
dense terms (a word or beginning that makes up DENSE percent of a text, twice at
least) that tell the labels apart: by a z-score of at least Z on document
frequencies, in MIN_DOCS documents at least, RATIO times as frequent, TERMS at most.
Near copies among the examples count as one document there, or the words of one text that
was copied often would pass for words of its label.

Weights are (1 + ln tf) * idf. idf is taken over all documents of the corpus and lowered by ln COMMON, so that
a term in more than one of COMMON documents weighs nothing; telling terms weigh
BOOST times their idf. Vectors have length 1.

The index holds, for each term, the examples' weights and the greatest weight
in each block of BLOCK examples. A document sums these maxima into a bound per
block, visits the FIRST blocks of the highest bounds, and then all whose bound is not
under its K-th best example: the K nearest are exact. Neighbours vote with
their similarity as weight against PRIOR votes for the examples' rate; isotonic
regression on votes of the examples, each without its own near copies, makes the vote a
calibrated probability, where examples stand for all labelled texts of their label.
The ids of the neighbours are the evidence.

The index is bounded by the constants here and by the examples' texts, whatever the corpus' size, and is
the only thing sent to executors; each Python worker holds it.
Documents are counted and scored where they are read; only hashes meet the labels.

Defined cases: null and empty texts, and texts without any term of the index, get the
rate of such examples; labels other than 0 and 1 and documents without
label are not learned from; where no usable label exists the score is 0;
repeated rows score alike; ties between neighbours go by the hash of their text; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Polynomial, U, mix, ragged, shared_checkpoint, slices, words_of

EXAMPLES, TERMS, STEMS, DENSE = 3000, 4096, (4, 5, 7), (1, 2, 4)
Z, MIN_DOCS, RATIO = 5.0, 5, 4.0
COMMON, BOOST = 8.0, 16.0
#: Examples that share a band of minwise word triples are near copies.
BANDS, BAND_ROWS = 24, 4
K, BLOCK, FIRST, PRIOR = 15, 128, 4, 1.0
THRESHOLD = 0.7
#: Bits of a term's hash, beside which the row's number stands.
TERM_BITS = 48
_TERM = U((1 << TERM_BITS) - 1)


def _letters(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The texts lower-cased, with one space for all that is no letter."""
    low = pc.utf8_lower(batch.column("text").cast(pa.string()).fill_null(""))
    return pa.RecordBatch.from_arrays([pc.replace_substring_regex(low, r"[^\pL\pM]+", " ")], ["text"])


class Terms:
    """The terms of some texts: hash, frequency and text, by text and hash; a word's own hash is what `words` has."""

    def __init__(self, batch: pa.RecordBatch, telling: np.ndarray | None = None):
        """telling: the hashes of those beginnings and dense terms that are wanted, sorted; all without it."""
        words = words_of(_letters(batch))
        doc, n = words.doc().astype(U) << U(TERM_BITS), len(words.count)
        keys, counts = [], []
        kinds = [(doc, words.hash & _TERM)]
        for size in STEMS:
            long = np.flatnonzero(words.end - words.start > size)
            kinds.append((doc[long], mix(words.poly.hashes(words.start[long], words.start[long] + size) + U(size)) & _TERM))
        for k, (d, h) in enumerate(kinds):
            key, count = np.unique(d | h, return_counts=True)
            for percent in DENSE:
                total = words.count[(key >> U(TERM_BITS)).astype(np.int64)]
                often = key[(count > 1) & (100 * count >= percent * total)]
                marked = (often & ~_TERM) | (mix((often & _TERM) + U(percent << TERM_BITS)) & _TERM)
                keys.append(self._only(marked, telling))
                counts.append(np.ones(len(keys[-1]), np.int64))
            keep = np.ones(len(key), bool) if k == 0 else self._is(key, telling)
            keys.append(key[keep])
            counts.append(count[keep])
        key, count = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(key, kind="stable")
        key = key[order]
        self.hash, self.count = key & _TERM, count[order]
        self.first = np.searchsorted(key, np.arange(n + 1).astype(U) << U(TERM_BITS))
        self.text = (key >> U(TERM_BITS)).astype(np.int64)

    @staticmethod
    def _is(key: np.ndarray, telling: np.ndarray | None) -> np.ndarray:
        return np.ones(len(key), bool) if telling is None else _place(telling, key & _TERM) >= 0

    @classmethod
    def _only(cls, key: np.ndarray, telling: np.ndarray | None) -> np.ndarray:
        return key[cls._is(key, telling)]


def _place(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where in a sorted table each value stands, -1 where it does not."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def _stretches(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All places of stretches, one after the other."""
    total = int(length.sum())
    return np.arange(total) + np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) if total else np.zeros(0, np.int64)


class Index:
    """Examples in blocks, with block maxima for each term.

    vectors: for each example the places of its terms in a vocabulary of `size` terms, and
    their weights; family: examples with equal values are near copies; standing: for how many labelled texts an example of label 0 and of 1 stands.
    """

    def __init__(self, size: int, vectors: list[tuple[np.ndarray, np.ndarray]], labels, ids: list, family=None, standing=(1.0, 1.0)):
        self.ids, self.labels, self.standing = ids, np.array(labels, np.float64), standing
        self.family = np.arange(len(ids)) if family is None else np.array(family)
        self.blocks = -(-len(ids) // BLOCK)
        term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in vectors)]).astype(np.int64)
        example = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        weight = np.concatenate([np.zeros(0), *(w for _, w in vectors)])
        order = np.lexsort((example, term))
        term, self.example, self.weight = term[order], example[order], weight[order]
        cell = term * max(1, self.blocks) + self.example // BLOCK
        new = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        self.start = np.append(new, len(cell)).astype(np.int64)
        self.most = np.maximum.reduceat(self.weight, new) if len(new) else np.zeros(0)
        self.block = (cell[new] % max(1, self.blocks)).astype(np.int64)
        self.of_term = np.searchsorted(cell[new] // max(1, self.blocks), np.arange(size + 1))
        self.rate = float(self.labels.mean()) if len(ids) else 0.0
        self.curve: tuple[np.ndarray, np.ndarray] | None = None
        self.bare = self.rate

    def nearest(self, terms: np.ndarray, weights: np.ndarray, without: int = -1, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, examples) of the k of the highest positive cosine, best first, ties by place; without: a family left out."""
        begin = self.of_term.take(terms)
        n = self.of_term.take(terms + 1) - begin
        cells, w = _stretches(begin, n), np.repeat(weights, n)
        block = self.block.take(cells)
        bound = np.bincount(block, weights=w * self.most.take(cells), minlength=self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best = (np.zeros(0), np.zeros(0, np.int64))
        for turn in (order[:FIRST], order[FIRST:]):
            if len(best[0]) == k:
                turn = turn[bound[turn] >= best[0][-1] - 1e-9]
            if not len(turn):
                break
            visit = np.zeros(self.blocks, bool)
            visit[turn] = True
            here = np.flatnonzero(visit.take(block))
            own = cells.take(here)
            begin = self.start.take(own)
            n = self.start.take(own + 1) - begin
            at = _stretches(begin, n)
            score = np.bincount(self.example.take(at), weights=np.repeat(w.take(here), n) * self.weight.take(at), minlength=len(self.ids))
            if without >= 0:
                score[self.family == without] = 0
            hit = np.flatnonzero(score > 0)
            if len(hit) > 4 * k:  # the k best, and what ties with the last of them once rounded
                hit = hit[score[hit] >= np.partition(score[hit], len(hit) - k)[len(hit) - k] - 1e-11]
            score, hit = np.concatenate([best[0], np.round(score[hit], 12)]), np.concatenate([best[1], hit])
            top = np.lexsort((hit, -score))[:k]
            best = (score[top], hit[top])
        return best

    def vote(self, score: np.ndarray, near: np.ndarray) -> float:
        return float(((score * self.labels[near]).sum() + PRIOR * self.rate) / (score.sum() + PRIOR))

    def calibrate(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Isotonic regression of labels on votes without near copies, and the rate of examples without neighbours."""
        near = [self.nearest(t, w, self.family[e]) for e, (t, w) in enumerate(vectors)]
        stand = np.where(self.labels > 0, self.standing[1], self.standing[0])
        true = float((stand * self.labels).sum() / stand.sum()) if len(stand) else 0.0
        none = np.array([not len(n) for _, n in near], bool)
        self.bare = float(((stand * self.labels)[none].sum() + true) / (stand[none].sum() + 1))
        some = sorted((self.vote(*near[e]), self.labels[e], stand[e]) for e in np.flatnonzero(~none))
        pools: list[list[float]] = []
        for x, y, n in some:
            pools.append([x, x, n * y, n])
            while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
                _, b, y2, n2 = pools.pop()
                pools[-1] = [pools[-1][0], b, pools[-1][2] + y2, pools[-1][3] + n2]
        x = [v for a, b, _, _ in pools for v in (a, b)]
        y = [v for _, _, y, n in pools for v in ((y + true) / (n + 1),) * 2]
        self.curve = (np.array(x), np.array(y)) if x else None

    def score(self, terms: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray]:
        """The calibrated vote on a vector, and its nearest examples."""
        found, near = self.nearest(terms, weights)
        if not len(near):
            return self.bare, near
        vote = self.vote(found, near)
        value = float(np.interp(vote, *self.curve)) if self.curve else vote
        return min(1.0, max(0.0, value)), near


def vectors(terms: Terms, vocabulary: np.ndarray, weight: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the places of its terms in the vocabulary, and their weights in a vector of length 1; terms that weigh nothing are left out."""
    place = _place(vocabulary, terms.hash)
    w = np.where(place >= 0, (1 + np.log(terms.count)) * weight[place], 0.0) if len(vocabulary) else np.zeros(len(place))
    keep = w > 0
    first = np.concatenate([[0], np.cumsum(keep)])[terms.first]
    place, w = place[keep], w[keep]
    norm = np.sqrt(np.add.reduceat(np.append(w * w, 0.0), np.minimum(first[:-1], len(w)))) if len(first) > 1 else np.zeros(0)
    return [(place[a:b], w[a:b] / norm[d]) for d, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True))]


def weights_of(vocabulary: np.ndarray, telling: np.ndarray, frequency: np.ndarray, documents: int) -> np.ndarray:
    """The idf of each term from its documents, lowered by ln COMMON; of telling terms BOOST times the whole."""
    idf = np.log((1 + documents) / (1 + np.minimum(frequency, documents)))
    return np.where(_place(telling, vocabulary) >= 0, BOOST * (idf + 1), np.maximum(idf - math.log(COMMON), 0.0))


def near_copy_keys(batch: pa.RecordBatch) -> np.ndarray:
    """A row of BANDS keys for each text; 0 for texts of under three words."""
    seeds = np.random.default_rng(6).integers(1, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) | U(1)
    words = words_of(batch, fold=True)
    grams = Polynomial(words.hash).windows(3)
    fits = words.room()[: len(grams)] >= 3
    edges = np.minimum(words.first, len(grams))
    out = np.zeros((batch.num_rows, BANDS), U)
    for d in range(batch.num_rows):
        own = grams[edges[d] : edges[d + 1]][fits[edges[d] : edges[d + 1]]]
        if len(own):
            least = np.array([(own * s).min() for s in seeds], U)
            out[d] = Polynomial(least).hashes(np.arange(BANDS) * BAND_ROWS, np.arange(1, BANDS + 1) * BAND_ROWS) | U(1)
    return out


def families(keys: list[np.ndarray]) -> list[int]:
    """For each row of band keys the place of the first that it is a near copy of, over any number of steps."""
    up = list(range(len(keys)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    first: dict[tuple[int, int], int] = {}
    for i, row in enumerate(keys):
        for band, key in enumerate(row.tolist()):
            if key:
                other, mine = root(first.setdefault((band, key), i)), root(i)
                up[max(mine, other)] = min(mine, other)
    return [root(i) for i in range(len(keys))]


def tells(a: Column, b: Column, n1: int, n0: int) -> Column:
    """The z-score of a term in a of n1 and b of n0 documents; null where it does not tell them apart."""
    p, q = (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1)
    m = (a + b + 1) / (n1 + n0 + 2)
    z = F.abs(p - q) / F.sqrt(m * (1 - m) * (1 / n1 + 1 / n0))
    return F.when((a + b >= MIN_DOCS) & (z >= Z) & (F.greatest(p / q, q / p) >= RATIO), z)


def examples(docs: DataFrame, labels: DataFrame, each: int = EXAMPLES) -> tuple[DataFrame, tuple[float, float]]:
    """(h, doc_id, toxic, text) of at most `each` labelled texts of each label, those of the least hashes, never of held-out ids; and for how many texts one of each label stands."""
    known = labels.where(F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    hashed = docs.where(F.length("text") > 0).select("doc_id", F.xxhash64("text").alias("h"))
    rows = shared_checkpoint(hashed.join(known, "doc_id").groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").cast("int").alias("toxic")))
    total = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = []
    for y in (0, 1):
        some = rows.where(F.col("toxic") == y)
        share = (each + 8 * math.sqrt(each) + 20) / max(1, total.get(y, 0))
        if share < 1:  # hashes are even, so below this one lie a few more than needed
            some = some.where(F.col("h") < int(share * 2**64) - 2**63)
        chosen.append(some.orderBy("h").limit(each))
    chosen = chosen[0].unionByName(chosen[1])
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(F.broadcast(chosen), ["doc_id", "h"]).dropDuplicates(["h"])
    return shared_checkpoint(texts.select("h", "doc_id", "toxic", "text")), tuple(max(1.0, total.get(y, 0) / each) for y in (0, 1))


def _by_text(function, *names: str):
    """For mapInArrow: `function` on slices of rows with a text gives the columns named."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            yield pa.RecordBatch.from_arrays(function(batch), list(names))

    return mapped


def build(found: DataFrame, docs: DataFrame, standing: tuple[float, float] = (1.0, 1.0)) -> tuple[np.ndarray, np.ndarray, np.ndarray, Index]:
    """(vocabulary, weights, telling, index) from examples (h, doc_id, toxic, text) and all documents."""
    keys = found.mapInArrow(_by_text(lambda b: [b.column("h"), pa.array([r.tobytes() for r in near_copy_keys(b)], pa.binary()), b.column("toxic")], "h", "keys", "toxic"), "h long, keys binary, toxic int")
    keys = sorted((r.h, r["keys"], r.toxic) for r in keys.collect())
    family = dict(zip((h for h, _, _ in keys), families([np.frombuffer(bytes(k), U) for _, k, _ in keys]), strict=True))
    first: dict[tuple[int, int], int] = {}
    for h, _, y in keys:
        first.setdefault((family[h], y), h)
    heads, n = np.array(sorted(first.values()), np.int64), [sum(y == k for _, y in first) for k in (0, 1)]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            batch = batch.filter(pa.array(np.isin(batch.column("h").to_numpy(), heads)))
            terms = Terms(batch)
            y = batch.column("toxic").to_numpy()[terms.text] if len(terms.text) else np.zeros(0, np.int64)
            h, at = np.unique(terms.hash, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *(pa.array(np.bincount(at[y == k], minlength=len(h))) for k in (1, 0))], ["term", "a", "b"])

    rated = found.mapInArrow(counted, "term long, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    rated = rated.withColumn("z", tells(F.col("a"), F.col("b"), max(1, n[1]), max(1, n[0]))).where("z is not null")
    telling = np.array(sorted(r.term for r in rated.orderBy(F.desc("z"), "term").limit(TERMS).collect()), np.int64).view(U)

    def listed(batch: pa.RecordBatch) -> list[pa.Array]:
        terms = Terms(batch, telling)
        size = np.diff(terms.first)
        return [*(batch.column(c) for c in ("h", "doc_id", "toxic")), ragged(terms.hash.view(np.int64), size), ragged(terms.count.astype(np.int32), size)]

    kind = found.schema["doc_id"].dataType.simpleString()
    rows = found.mapInArrow(_by_text(listed, "h", "doc_id", "toxic", "terms", "counts"), f"h long, doc_id {kind}, toxic int, terms array<bigint>, counts array<int>").toArrow().combine_chunks()
    rows = rows.take(pc.sort_indices(rows.column("h")))
    terms = Terms.__new__(Terms)
    flat = lambda name: np.concatenate([np.zeros(0, np.int64), *(c.flatten().to_numpy() for c in rows.column(name).chunks)])
    terms.hash, terms.count = flat("terms").view(U), flat("counts")
    terms.first = np.concatenate([[0], np.cumsum(pc.list_value_length(rows.column("terms")).to_numpy())]).astype(np.int64)
    vocabulary = np.unique(terms.hash)
    held = docs.sparkSession.sparkContext.broadcast((vocabulary, telling))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, some = held.value
        seen, n = np.zeros(len(table), np.int64), 0
        for batch in (s for b in batches for s in slices(b)):
            place = _place(table, Terms(batch, some).hash)
            seen += np.bincount(place[place >= 0], minlength=len(table))
            n += batch.num_rows
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], n))], ["place", "n"])

    seen = docs.select("text").mapInArrow(frequencies, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    frequency, place = np.zeros(len(vocabulary) + 1, np.int64), seen.column("place").to_numpy()
    frequency[place] = seen.column("n").to_numpy()
    weight = weights_of(vocabulary, telling, frequency[:-1], int(frequency[-1]))
    own = vectors(terms, vocabulary, weight)
    h = rows.column("h").to_pylist()
    index = Index(len(vocabulary), own, rows.column("toxic").to_numpy(), rows.column("doc_id").to_pylist(), [family[x] for x in h], standing)
    index.calibrate(own)
    return vocabulary, weight, telling, index


def score_toxicity(docs: DataFrame, labels: DataFrame, each: int = EXAMPLES) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (ids of the nearest examples) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(build(*(lambda e: (e[0], docs, e[1]))(examples(docs, labels, each))))

    def scored(batch: pa.RecordBatch) -> list[pa.Array]:
        vocabulary, weight, telling, index = shared.value
        out = [index.score(*v) for v in vectors(Terms(batch, telling), vocabulary, weight)]
        evidence = pa.array([[str(index.ids[e]) for e in near] for _, near in out], pa.list_(pa.string()))
        return [batch.column("doc_id"), pa.array([s for s, _ in out], pa.float64()), evidence]

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(_by_text(scored, "doc_id", "score", "evidence"), f"doc_id {kind}, score double, evidence array<string>")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "evidence")
