"""Operator 11, cross-tokenizer alignment by bitsets of token ends.

Each text is encoded by a byte-level vocabulary (A, with a space in front) and a piece vocabulary
(B, which adds that space itself). The tokens' bytes are laid over the same text, and a packed bitset for each side has a
bit wherever a token ends. AND of both gives the shared cuts. A directory of counts by words of 64
bits and the popcount of what is left of a word give rank, which maps a byte cut to the token that
ends there; the shared cuts so cut both token rows into groups. A token of A meets the tokens of B between the ranks of its first and last byte:
these ranges expand to the links, all pairs of occurrences whose bytes overlap.

A's ids come from forced-boundary splitting. B's pieces hold a space in front only, so a cut before each run
of spaces is certain there too, and each distinct word with its spaces is encoded once in a task.

Corpus counts: a document's links are counted by id pair before they leave its task; counts of pairs are
sums over tasks. They come back to the documents by a join in two parts: the most
frequent pairs, FREQUENT of them at most, are broadcast, so no pair that is in most documents is shuffled; all others are
joined by shuffle.

Defined cases: null and empty texts, and texts whose joined tokens are not space and text, have no tokens: zeros
and an empty groups string; names of special tokens inside texts are plain text; texts of any length; ties for the
highest count of an id all are best; repeated rows are aligned and counted each; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Cache, Encoder, class_runs, joined, vocabulary
from .common import drop_folder, sha256_of, shared_checkpoint, shared_folder, slices, string_bytes

#: Bytes of text that are aligned at once; the arrays of tokens, links and digits are some hundred times as large.
TOGETHER = 1 << 18
#: Id pairs that are broadcast with their counts.
FREQUENT = 1 << 16
#: Ids are below 2**WIDE.
WIDE = 20


class Pieces:
    """A piece vocabulary: ids of words with the spaces before them, and the bytes of each id."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self._model = SentencePieceProcessor(model_file=path)
        self.size = self._model.get_piece_size()
        pieces = [self._model.id_to_piece(i) for i in range(self.size)]
        known = [b"" if self._model.is_control(i) else bytes([int(p[3:5], 16)]) if self._model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.apart = all("▁" not in p.lstrip("▁") for p in pieces)
        self._space = self._model.piece_to_id("▁")
        self.lengths = np.array([len(x) for x in known], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(known), np.uint8)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Of strings that begin with a space, which the model adds itself."""
        return [ids or [self._space] for ids in self._model.encode([w[1:].decode() for w in words], num_threads=1)]


@cache
def pieces(path: str | None) -> Pieces:
    import public_tokenizers

    return Pieces(path or public_tokenizers.path("piece_bpe_32k.model"))


class Bits:
    """A bitset with ranks."""

    def __init__(self, at: np.ndarray, size: int):
        bits = np.zeros(-(-(size + 1) // 64) * 64, bool)
        bits[at] = True
        self._set(np.packbits(bits, bitorder="little").view("<u8"))

    def _set(self, words: np.ndarray) -> None:
        self.words = words
        ones = np.bitwise_count(words).astype(np.int64)
        self._before = np.cumsum(ones) - ones

    def __and__(self, other: Bits) -> Bits:
        both = object.__new__(Bits)
        both._set(self.words & other.words)
        return both

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        rest = self.words[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self._before[at >> 6] + np.bitwise_count(rest)

    def select(self) -> np.ndarray:
        """The places of all set bits, by their rank."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space in front of each that is not empty."""
    size = np.diff(offsets)
    full = size > 0
    out = np.insert(data, offsets[:-1][full], 32)
    return out, np.concatenate([[0], np.cumsum(size + full)])


class Aligned:
    """Groups and links of the tokens of some texts.

    a, b: ids, only of texts that both sides give back; first_a, first_b: where each text's begin.
    """

    def __init__(self, a: tuple, b: tuple, sides: tuple, data: np.ndarray, offsets: np.ndarray):
        same = np.ones(len(offsets) - 1, bool)
        for (ids, first), side in zip((a, b), sides, strict=True):
            same &= _gives_back(side, ids.astype(np.int64), first, data, offsets)
        (self.a, self.first_a), (self.b, self.first_b) = (_only(ids.astype(np.int64), first, same) for ids, first in (a, b))
        ends = [np.cumsum(side.lengths[ids]) for ids, side in ((self.a, sides[0]), (self.b, sides[1]))]
        size = int(ends[0][-1]) if len(ends[0]) else 0
        ones = [Bits(e - 1, size) for e in ends]  # a token's last byte stands for its end
        shared = (ones[0] & ones[1]).select()
        self.cut_a, self.cut_b = (x.rank(shared) + 1 for x in ones)  # tokens up to each shared cut
        # tokens of B from the one that holds the first byte of a token of A to the one that holds its last
        low = ones[1].rank(ends[0] - sides[0].lengths[self.a]) if len(self.a) else self.a
        high = ones[1].rank(ends[0] - 1) if len(self.a) else self.a
        self.reach = high - low + 1
        self._ids = max(side.size for side in sides)
        self.link_a = np.repeat(self.a, self.reach)
        self.link_b = joined(self.b, low, self.reach)
        self.n_groups = np.diff(np.searchsorted(self.cut_a, self.first_a, "right"))
        self.n_links = np.diff(np.concatenate([[0], np.cumsum(self.reach)])[self.first_a])

    def groups(self) -> pa.Array:
        """For each text a1,a2|b1;a3|b2,b3: the ids of both sides, group by group."""
        starts_a, starts_b = (np.concatenate([[0], c[:-1]]) if len(c) else c for c in (self.cut_a, self.cut_b))
        of_a, of_b = (np.repeat(np.arange(len(c)), c - s) for c, s in ((self.cut_a, starts_a), (self.cut_b, starts_b)))
        at_a = np.arange(len(self.a)) + (starts_b[of_a] if len(of_a) else 0)
        at_b = np.arange(len(self.b)) + (self.cut_a[of_b] if len(of_b) else 0)
        ids, after = np.zeros(len(self.a) + len(self.b), np.int64), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        ids[at_a], ids[at_b] = self.a, self.b
        after[at_a[self.cut_a - 1]], after[at_b[self.cut_b - 1]] = ord("|"), ord(";")
        digits, starts, lengths = _decimals(self._ids)
        size = lengths[ids]
        out = joined(digits, starts[ids], size)
        out[np.cumsum(size) - 1] = after
        # each text's last separator goes
        first = np.concatenate([[0], np.cumsum(size)])[self.first_a + self.first_b]
        full = np.diff(first) > 0
        out = np.delete(out, first[1:][full] - 1)
        first = first - np.concatenate([[0], np.cumsum(full)])
        return pa.Array.from_buffers(pa.string(), len(first) - 1, [None, pa.py_buffer(first.astype(np.int32)), pa.py_buffer(out)])

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """a, b and number of each text's distinct linked id pairs, and where each text's begin."""
        doc = np.repeat(np.arange(len(self.n_links)), self.n_links)
        order = np.lexsort((self.link_a << WIDE | self.link_b, doc))
        a, b, doc = self.link_a[order], self.link_b[order], doc[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        return a[at], b[at], np.diff(np.append(at, len(a))), np.searchsorted(doc[at], np.arange(len(self.n_links) + 1))


@cache
def _decimals(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each number's decimal digits and one byte more: all bytes, where each begins, and how many it has."""
    names = [b"%d," % i for i in range(size)]
    lengths = np.array(list(map(len, names)), np.int64)
    return np.frombuffer(b"".join(names), np.uint8), np.cumsum(lengths) - lengths, lengths


def _gives_back(side, ids: np.ndarray, first: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts are the joined bytes of their ids."""
    size = np.concatenate([[0], np.cumsum(side.lengths[ids])])[first]
    same = np.diff(size) == np.diff(offsets)
    ids, first = _only(ids, first, same)
    made = joined(side.bytes, side.starts[ids], side.lengths[ids])
    wanted = data[np.repeat(same, np.diff(offsets))]
    wrong = np.concatenate([[0], np.cumsum(made != wanted)])
    at = np.concatenate([[0], np.cumsum(np.where(same, np.diff(offsets), 0))])
    return same & (np.diff(wrong[at]) == 0)


def _only(ids: np.ndarray, first: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids of the texts to keep; the others have none."""
    count = np.diff(first)
    return ids[np.repeat(keep, count)], np.concatenate([[0], np.cumsum(np.where(keep, count, 0))])


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (a1,a2|b1;a3|b2,b3), and the distinct linked id pairs with their numbers, as three arrays a, b, n."""
    runs, kind = class_runs(), docs.schema["doc_id"].dataType.simpleString()

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, other = vocabulary(a_path), pieces(b_path)
        encoder, cached = Encoder(words, runs, special=False), Cache(other.encode)
        for batch in (s for b in batches for s in slices(b, size=TOGETHER)):
            data, offsets = spaced(*string_bytes(batch.column("text")))
            cut = np.zeros(len(data) + 1, bool)
            cut[offsets] = True
            if other.apart:
                cut[1:-1] |= (data[1:] == 32) & (data[:-1] != 32)
            begin = np.flatnonzero(cut[:-1])
            ids, count = cached.ids(data, begin, np.append(begin[1:], len(data))[: len(begin)])
            b = ids, np.concatenate([[0], np.cumsum(count)])[np.searchsorted(begin, offsets)]
            one = Aligned(encoder.column(data, offsets), b, (words, other), data, offsets)
            a, b, n, first = one.pairs()
            lists = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (a, b, n)]
            counts = [pa.array(x) for x in (np.diff(one.first_a), np.diff(one.first_b), one.n_groups, one.n_links)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, one.groups(), *lists], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "a", "b", "n"])

    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(aligned, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, a array<int>, b array<int>, n array<int>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, count (links that hold the two ids linked), best (no other id of A has more with this id of B)."""
    counts = shared_checkpoint(_links(aligned).groupBy("a", "b").agg(F.sum("n").alias("count")))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return shared_checkpoint(counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best")))


def _links(aligned: DataFrame, *also: str) -> DataFrame:
    return aligned.select(*also, F.explode(F.arrays_zip("a", "b", "n")).alias("x")).select(*also, "x.*")


def frequent_pairs(counts: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The most frequent of the pairs, `most` at most, and whether these are all. Cut by a histogram of eighths of powers of two."""
    step = F.floor(8 * F.log2("count")).cast("int")
    bins = sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), reverse=True)  # 8 * 63 of them at most
    total, least = 0, None
    for at, n in bins:
        total += n
        if total > most:
            break
        least = at
    return counts.where(step >= least if least is not None else F.lit(False)), total <= most


def link_counts(aligned: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """Rows of align(), each with its own number in `row`: a, b and n give way to n_best (links of pairs that are best) and count_sum (the counts of all links)."""
    counts = pair_counts(aligned)
    often, all_of_them = frequent_pairs(counts, frequent)
    often = F.broadcast(often)
    sums = [F.sum(F.col("n") * F.col("count")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("n"))).alias("n_best")]
    links = _links(aligned, "row")
    told = links.join(often, ["a", "b"]).groupBy("row").agg(*sums)
    if not all_of_them:
        rest = links.join(often, ["a", "b"], "left_anti").join(counts.join(often, ["a", "b"], "left_anti"), ["a", "b"])
        told = told.unionByName(rest.groupBy("row").agg(*sums)).groupBy("row").agg(*[F.sum(x).alias(x) for x in ("count_sum", "n_best")])
    zero = [F.coalesce(x, F.lit(0)).alias(x) for x in ("n_best", "count_sum")]
    kept = [c for c in aligned.columns if c not in ("row", "a", "b", "n")]
    return aligned.join(told, "row", "left").select(*kept, *zero)


def alignment_digests(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs.

    The links are read three times, so they are written once, as columns that shrink to some bytes a pair, and deleted when all is counted.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/alignment-{uuid.uuid4().hex}"
    digest = F.when(F.col("groups") == "", "").otherwise(sha256_of("groups")).alias("groups_sha256")
    try:
        rows = align(docs, a_path, b_path).select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "a", "b", "n")
        rows.withColumn("row", F.monotonically_increasing_id()).write.parquet(folder)
        return shared_checkpoint(link_counts(spark.read.parquet(folder), frequent))
    finally:
        drop_folder(spark, folder)
