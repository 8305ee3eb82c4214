"""Operator 8, best-fit packing: bounded-space online best-fit.

Each document becomes its token ids and an end token. A document longer than a
sequence is cut into full sequences and, in front of them, a shorter first
piece. Pieces go one after the other into the open bin that they fill most. A
bitset with one bit per amount of free space finds that bin in one step; at
most OPEN bins are open, and beyond that the fullest closes.

Each task packs its own stream. What its bins hold at its end is not closed
but packed once more, bins as wholes, in far fewer tasks; so the loss per task
is small, and no task sees more than its share. The first round is
checkpointed before the second reads it, so a lost executor cannot mix two
different runs of a task.

Tokens are looked up by word: a chunk is blanks and the word behind them, which
byte-level BPE never merges with its neighbours; each distinct chunk of a task
is encoded once, by the same vocabulary in its faster library. Texts with blanks outside ASCII are
encoded whole.

Defined cases: null and empty text is one piece with the end token only;
repeated rows are packed each; ids in a text that look like special tokens
are those tokens; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, shared_checkpoint, slices, vocabulary, words_of

SEQUENCE, OPEN, END = 2048, 1024, 0
#: Distinct chunks, and ids of them, that a task keeps; then it starts anew.
CACHE, POOL = 1 << 18, 1 << 21
#: Bytes of text in which each distinct chunk is looked up once.
TOGETHER = 1 << 21
#: First-round tasks, by the bins they leave, for one task of the second round.
TASKS_TO_ONE = 64


class Encoder:
    """Token ids of whole columns, through a cache of chunks."""

    def __init__(self):
        self._bpe = vocabulary()
        self._clear()

    def _clear(self) -> None:
        self._place: dict[int, int] = {}
        self._pool, self._first, self._used = np.zeros(1 << 12, np.uint32), np.zeros(1 << 12, np.int64), 0

    def encode(self, text: str) -> np.ndarray:
        return np.array(self._bpe.encode(text, allowed_special="all"), np.uint32)

    def column(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a text column, and where each text's begin."""
        words = words_of(batch)
        raw = words.data.tobytes()
        odd = _odd_texts(words.data, words.bytes, raw)
        start = words.start.copy()
        follows = np.ones(len(start), bool)
        follows[words.first[:-1][words.count > 0]] = False
        start[1:] = words.end[:-1]
        heads = np.flatnonzero(~follows)
        start[heads] = words.bytes[:-1][words.count > 0]
        rest = np.where(words.count > 0, words.end[np.maximum(words.first[1:] - 1, 0)] if len(start) else 0, words.bytes[:-1])
        tail = np.flatnonzero(rest < words.bytes[1:])
        begin, stop = np.concatenate([start, rest[tail]]), np.concatenate([words.end, words.bytes[1:][tail]])
        doc = np.concatenate([words.doc(), tail])
        if len(tail):
            order = np.lexsort((begin, doc))
            begin, stop, doc = begin[order], stop[order], doc[order]
        keep = ~odd[doc]
        begin, stop, doc = begin[keep], stop[keep], doc[keep]
        distinct, one, which = np.unique(words.poly.hashes(begin, stop), return_index=True, return_inverse=True)
        places = self._lookup(distinct, begin[one], stop[one], raw)
        place = places[which]
        count = self._first[place + 1] - self._first[place]
        ids = self._pool[np.arange(count.sum()) + np.repeat(self._first[place] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)] if len(place) else np.zeros(0, np.uint32)
        size = np.bincount(doc, weights=count, minlength=len(words.count)).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(size)])
        if not odd.any():
            return ids, first
        own = [self.encode(raw[words.bytes[d] : words.bytes[d + 1]].decode()) if odd[d] else ids[first[d] : first[d + 1]] for d in range(len(size))]
        return np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])

    def _lookup(self, distinct: np.ndarray, begin: np.ndarray, stop: np.ndarray, raw: bytes) -> np.ndarray:
        if len(self._place) + len(distinct) > CACHE or self._used > POOL:
            self._clear()
        got = list(map(self._place.get, distinct.tolist()))
        missing = [k for k, v in enumerate(got) if v is None]
        if missing:
            known = distinct.tolist()
            encode = self._bpe.encode_ordinary
            new = [encode(raw[i:j].decode()) for i, j in zip(begin[missing].tolist(), stop[missing].tolist(), strict=True)]
            base = len(self._place)
            for n, k in enumerate(missing):
                self._place[known[k]] = got[k] = base + n
            lengths = np.fromiter(map(len, new), np.int64, len(new))
            to, total = base + len(new), self._used + int(lengths.sum())
            self._first, self._pool = _room(self._first, to + 1), _room(self._pool, total)
            self._first[base + 1 : to + 1] = self._used + np.cumsum(lengths)
            self._pool[self._used : total] = np.fromiter((x for ids in new for x in ids), np.uint32, total - self._used)
            self._used = total
        return np.array(got, np.int64)


def _room(values: np.ndarray, n: int) -> np.ndarray:
    """values, in an array of twice the length if n do not fit."""
    return values if n <= len(values) else np.concatenate([values, np.zeros(max(n, 2 * len(values)) - len(values), values.dtype)])


def _odd_texts(data: np.ndarray, offsets: np.ndarray, raw: bytes) -> np.ndarray:
    """Texts with blanks outside ASCII, or with a special token's name."""
    at = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    pad = np.concatenate([data, np.zeros(2, np.uint8)])
    a, b, c = pad[at], pad[at + 1], pad[at + 2]
    blank = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    blank |= (a == 0xE1) & (b == 0x9A) & (c == 0x80)
    blank |= (a == 0xE2) & (((b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    blank |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
    spots = at[blank].tolist()
    i = raw.find(b"<|endoftext|>")
    while i >= 0:
        spots.append(i)
        i = raw.find(b"<|endoftext|>", i + 1)
    odd = np.zeros(len(offsets) - 1, bool)
    if spots:
        odd[np.searchsorted(offsets, spots, "right") - 1] = True
    return odd


class Packer:
    """Open bins by free space. Items are anything with a length."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.bits, self.open = 0, 0
        self.bins: list[list[list]] = [[] for _ in range(size + 1)]

    def add(self, length: int, item) -> list | None:
        """Place an item; a bin's items if that closes one."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.size, []
        bin_.append(item)
        free -= length
        if free == 0:
            return bin_
        self._put(free, bin_)
        if self.open > self.most:
            return self._take((self.bits & -self.bits).bit_length() - 1)
        return None

    def _take(self, free: int) -> list:
        own = self.bins[free]
        bin_ = own.pop()
        self.open -= 1
        if not own:
            self.bits &= ~(1 << free)
        return bin_

    def _put(self, free: int, bin_: list) -> None:
        self.bins[free].append(bin_)
        self.bits |= 1 << free
        self.open += 1

    def rest(self) -> list[tuple[int, list]]:
        """The bins still open, by how much they hold."""
        return [(self.size - free, b) for free in range(self.size + 1) for b in self.bins[free]]


def _pieces(size: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()  # its chunks go with the task, as the worker lives on
        for batch in (s for b in batches for s in slices(b, size=TOGETHER)):
            ids, first = encoder.column(batch)
            rows = []
            for d in range(batch.num_rows):
                own = np.append(ids[first[d] : first[d + 1]], np.uint32(END)).astype("<u4")
                at, to = 0, (len(own) - 1) % size + 1
                while at < len(own):
                    rows.append((d, len(rows), at, to - at, zlib.crc32(own[at:to].tobytes())))
                    at, to = to, to + size
            doc, _, start, length, crc = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            piece = np.arange(len(doc)) - np.searchsorted(doc, doc)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), *map(pa.array, (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return pieces


_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]
_PLACED = [*_COLUMNS, "sequence_id", "offset", "tail"]


def _first_round(size: int, most: int):
    """Pieces into bins; the bins of a task's end are marked as tail."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, number = Packer(size, most), TaskContext.get().partitionId() << 36
        for batch in batches:
            out, seq = [], []
            for row in zip(*(batch.column(c).to_pylist() for c in _COLUMNS), strict=True):
                closed = packer.add(row[3], row)
                if closed:
                    out.append(closed)
                    seq.append(number)
                    number += 1
            yield _placed(out, seq, False, batch.schema)
            schema = batch.schema
        rest = packer.rest()
        if rest:
            yield _placed([b for _, b in rest], range(number, number + len(rest)), True, schema)

    return packed


def _placed(bins: list[list], numbers, tail: bool, schema: pa.Schema) -> pa.RecordBatch:
    rows, offsets, seqs = [], [], []
    for b, number in zip(bins, numbers, strict=True):
        at = 0
        for row in b:
            rows.append(row)
            offsets.append(at)
            seqs.append(number)
            at += row[3]
    columns = [pa.array([r[k] for r in rows], schema.field(c).type) for k, c in enumerate(_COLUMNS)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(seqs, pa.int64()), pa.array(offsets, pa.int64()), pa.array([tail] * len(rows), pa.bool_())], _PLACED)


def _second_round(size: int, most: int):
    """Whole bins (sequence_id, used) into sequences: where each goes."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, number, out = Packer(size, most), (1 << 62) + (TaskContext.get().partitionId() << 36), []
        for batch in batches:
            for one in zip(batch.column("used").to_pylist(), batch.column("sequence_id").to_pylist(), strict=True):
                closed = packer.add(one[0], one)
                if closed:
                    out.append(closed)
        moved = [(seq, number + k, sum(u for u, _ in b[:i])) for k, b in enumerate(out + [b for _, b in packer.rest()]) for i, (_, seq) in enumerate(b)]
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in moved], pa.int64()) for k in range(3)], ["sequence_id", "new_id", "shift"])

    return packed


def pack(docs: DataFrame, size: int = SEQUENCE, most: int = OPEN) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece of each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces, bins = _pieces(size), _first_round(size, most)
    # one function, so that a task needs one Python worker
    first = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lambda batches: bins(pieces(batches)), f"{rows}, sequence_id long, offset long, tail boolean")
    first = shared_checkpoint(first.repartition(partitions(docs.sparkSession), "sequence_id"))
    bins = first.where("tail").groupBy("sequence_id").agg(F.sum("length").alias("used"))
    bins = bins.repartition(1 + bins.count() // (TASKS_TO_ONE * most), "sequence_id").sortWithinPartitions(F.desc("used"), "sequence_id")
    moves = shared_checkpoint(bins.mapInArrow(_second_round(size, most), "sequence_id long, new_id long, shift long"))
    tails = first.where("tail").join(moves, "sequence_id").select(*_COLUMNS, F.col("new_id").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset"))
    return first.where("NOT tail").select(*_COLUMNS, "sequence_id", "offset").unionByName(tails)
