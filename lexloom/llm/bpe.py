"""Operator 13, BPE encoding and decoding by forced-boundary splitting.

Two neighbouring bytes that stand next to each other in no vocabulary token can
never be merged, so a cut between them is certain. Byte-level BPE also never merges over the
bounds of its splitting pattern; where such a bound is not certain by its bytes (blanks
before a word, contractions), it is found from the classes of the characters around it.
What lies between two cuts is a fragment. Fragments are encoded independently and their ids
concatenated; that is exact, because merges of one fragment neither see nor touch another.

Cuts are found over whole Arrow columns: a table of 65,536 byte pairs, and a table of classes by
code point. Each distinct fragment of a slice is looked up in a cache of bounded size; only
new ones are encoded, by the vocabulary's own merges. Nothing is exchanged between tasks.

Decoding gathers the bytes of the ids from one table; what is no UTF-8 becomes U+FFFD, as
decoders of this kind do it, and ids outside the vocabulary have no bytes.

Defined cases: null and empty texts have no ids and decode to an empty text; names of special
tokens inside a text are those tokens, unless special=False makes them plain text; fragments and texts
may be of any length; repeated rows are encoded each; null and repeated ids of documents pass through; other columns
pass only if named; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Polynomial, _byte_powers, _BYTES, slices, string_bytes

#: Distinct fragments, and ids of them, that a task keeps; then it starts anew.
CACHE, POOL = 1 << 18, 1 << 21
#: Bytes of text in which each distinct fragment is looked up once.
TOGETHER = 1 << 20
LETTER, NUMBER, BLANK, OTHER = 1, 2, 3, 0


@cache
def class_runs() -> tuple[np.ndarray, np.ndarray]:
    """Where runs of code points of one class begin, and the class: by the tokenizers library's own tables, whatever their Unicode version. Planes from 4 on hold neither letters nor numbers nor blanks."""
    from tokenizers import Regex, pre_tokenizers

    points = np.delete(np.arange(0x40000), np.s_[0xD800:0xE000])
    text, of = points.astype("<u4").tobytes().decode("utf-32-le"), np.zeros(len(points), np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        inside = np.ones(len(points), bool)
        for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed").pre_tokenize_str(text):
            inside[a:b] = False
        of[inside] = kind
    of[-1] = OTHER  # and so is all that follows
    at = np.flatnonzero(np.diff(of, prepend=255))
    return points[at], of[at]


class Vocabulary:
    """A byte-level vocabulary: the bytes of each id, the pairs that occur in none, the special tokens, and the merges."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        kind = told["pre_tokenizer"] or {}
        if told["normalizer"] or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True):
            raise ValueError(f"{path}: not a byte-level vocabulary without normalizer and prefix")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]  # these are written as the characters from 256 on
        self.letters = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}
        byte_of = {chr(c): b for b, c in self.letters.items()}
        self.special = {x["content"].encode(): x["id"] for x in told["added_tokens"]}
        entries = {i: bytes(byte_of[c] for c in token) for token, i in told["model"]["vocab"].items()}
        seen = np.zeros(1 << 16, bool)
        for token in entries.values():
            if len(token) > 1:
                b = np.frombuffer(token, np.uint8).astype(np.int64)
                seen[b[:-1] << 8 | b[1:]] = True
        self.never = ~seen
        entries |= {i: token for token, i in self.special.items()}
        self.size = max(entries) + 1
        self.lengths = np.array([len(entries.get(i, b"")) for i in range(self.size)], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(entries.get(i, b"") for i in range(self.size)), np.uint8)
        self._model = Tokenizer.from_file(path).model

    def fragment(self, raw: bytes) -> list[int]:
        """The ids of one fragment, by the merges alone."""
        return [t.id for t in self._model.tokenize(raw.decode("latin-1").translate(self.letters))]


@cache
def vocabulary(path: str | None) -> Vocabulary:
    import public_tokenizers

    return Vocabulary(path or public_tokenizers.path("byte_bpe_50k.json"))


def joined(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranges of values that begin at starts, one after the other."""
    shift = starts - (np.cumsum(lengths) - lengths)
    return values[np.arange(int(lengths.sum())) + np.repeat(shift, lengths)]


class Cache:
    """Ids of distinct byte strings, by their hashes; holds CACHE strings and POOL ids, and what one call needs."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]]):
        self._encode = encode
        self._clear()

    def _clear(self) -> None:
        self._place: dict[int, int] = {}
        self._pool, self._first = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def ids(self, data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the byte ranges, in order, and how many each has."""
        distinct, one, which = np.unique(Polynomial(_BYTES[data], _byte_powers).hashes(begin, stop), return_index=True, return_inverse=True)
        if len(self._place) + len(distinct) > CACHE or len(self._pool) > POOL:
            self._clear()
        known = distinct.tolist()
        place = list(map(self._place.get, known))
        new = [k for k, p in enumerate(place) if p is None]
        if new:
            raw = data.tobytes()
            got = self._encode([raw[i:j] for i, j in zip(begin[one[new]].tolist(), stop[one[new]].tolist(), strict=True)])
            base = len(self._place)
            for n, k in enumerate(new):
                self._place[known[k]] = place[k] = base + n
            lengths = np.fromiter(map(len, got), np.int64, len(got))
            self._first = np.concatenate([self._first, self._first[-1] + np.cumsum(lengths)])
            self._pool = np.concatenate([self._pool, np.fromiter((x for ids in got for x in ids), np.uint32, int(lengths.sum()))])
        at = np.array(place, np.int64)[which]
        count = self._first[at + 1] - self._first[at]
        return joined(self._pool, self._first[at], count), count


def code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code points whose UTF-8 begins at these places."""
    more = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
    a, b, c, d = (more[at + k] & 0x3F for k in range(4))
    first = more[at]
    return np.select([first < 0x80, first < 0xE0, first < 0xF0], [first, (first & 0x1F) << 6 | b, (first & 0xF) << 12 | b << 6 | c], (first & 7) << 18 | b << 12 | c << 6 | d)


def pattern_starts(kind: np.ndarray, byte: np.ndarray, head: np.ndarray) -> np.ndarray:
    """At which characters the splitting pattern begins a piece; kind and first byte of each, head where a text begins."""
    n = len(kind)
    if not n:
        return np.zeros(0, bool)
    blank, before = kind == BLANK, np.roll(kind, 1)
    start = (kind != before) & ~((np.roll(byte, 1) == 32) & ~blank)  # one space goes with what follows it
    follows = np.append(~head[1:], False)  # of the same text another character
    start |= blank & (before == BLANK) & follows & np.append(~blank[1:], False)  # the last blank before a word leaves the others
    start |= head
    tick = np.flatnonzero((byte == 39) & start & follows)
    for ending in (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll"):
        at = tick[tick + len(ending) < n]
        ok = np.ones(len(at), bool)
        for k, letter in enumerate(ending):
            ok &= (byte[at + k + 1] == letter) & ~head[at + k + 1]
        start[at[ok] + 1] = False
        after = at[ok] + len(ending) + 1
        start[after[after < n]] = True
    return start


class Encoder:
    """Token ids of whole columns."""

    def __init__(self, words: Vocabulary, runs: tuple[np.ndarray, np.ndarray], special: bool = True):
        self.words, self.special = words, special
        self._runs, self._kinds = runs
        self._ascii = self._kinds[np.searchsorted(self._runs, np.arange(128), "right") - 1]
        self._cache = Cache(lambda fragments: list(map(words.fragment, fragments)))

    def fragments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of each fragment of the texts; and which are special tokens, and their ids."""
        n = len(data)
        chars = np.flatnonzero((data & 0xC0) != 0x80)
        byte = data[chars]
        kind = self._ascii[byte & 0x7F]
        far = np.flatnonzero(byte >= 0x80)
        kind[far] = self._kinds[np.searchsorted(self._runs, code_points(data, chars[far]), "right") - 1]
        heads = np.zeros(n + 1, bool)
        heads[offsets] = True
        names = self._names(data, offsets)
        for a, b, _ in names:
            heads[[a, b]] = True
        start = np.zeros(n + 1, bool)
        start[chars[pattern_starts(kind, byte, heads[chars])]] = True
        if n:
            start[1:-1] |= self.words.never[data[:-1].astype(np.int64) << 8 | data[1:]]
        for a, b, _ in names:
            start[a + 1 : b] = False
        begin = np.flatnonzero(start[:n])
        whole = np.searchsorted(begin, [a for a, _, _ in names])
        return begin, np.append(begin[1:], n)[: len(begin)], whole, np.array([i for _, _, i in names], np.uint32)

    def _names(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(begin, end, id) of the special tokens' names, each inside one text, leftmost first."""
        found, raw = [], data.tobytes() if self.special else b""
        for name, i in self.words.special.items():
            a = raw.find(name)
            while a >= 0:
                if np.searchsorted(offsets, a, "right") == np.searchsorted(offsets, a + len(name) - 1, "right"):
                    found.append((a, a + len(name), i))
                a = raw.find(name, a + 1)
        out: list[tuple[int, int, int]] = []
        for one in sorted(found, key=lambda x: (x[0], -x[1])):
            if not out or one[0] >= out[-1][1]:
                out.append(one)
        return out

    def column(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts at these offsets of data, and where each text's begin."""
        begin, end, whole, own = self.fragments(data, offsets)
        ids, count = self._cache.ids(data, begin, end)
        if len(whole):
            keep = np.ones(len(begin), bool)
            keep[whole] = False
            parts = np.repeat(keep, count)
            spare = count.copy()
            spare[whole] = 1
            new = np.zeros(int(spare.sum()), np.uint32)
            slot = np.repeat(keep, spare)
            new[slot], new[~slot] = ids[parts], own
            ids, count = new, spare
        total = np.concatenate([[0], np.cumsum(count)])
        return ids, total[np.searchsorted(begin, offsets)]


def packed(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """A binary column: for each row its values, as they lie in memory."""
    offsets = (first * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def texts_of(words: Vocabulary, ids: np.ndarray, first: np.ndarray) -> pa.Array:
    """The texts of ids; first: where each row's begin."""
    if len(ids) and int(ids.max()) >= words.size:
        known = ids < words.size
        first = np.concatenate([[0], np.cumsum(known)])[first]
        ids = ids[known]
    ids = ids.astype(np.int64)
    data = joined(words.bytes, words.starts[ids], words.lengths[ids])
    offsets = np.concatenate([[0], np.cumsum(words.lengths[ids])])[first]
    out = pa.Array.from_buffers(pa.string(), len(first) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    try:
        out.validate(full=True)
    except pa.ArrowInvalid:
        raw = data.tobytes()
        out = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.string())
    return out


def _extended(schema: T.StructType, *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(name, kind) for name, kind in more)])


def encode(docs: DataFrame, *also: str, special: bool = True, decoded: bool = False, path: str | None = None) -> DataFrame:
    """doc_id, columns named in also, n_tokens and ids (little-endian unsigned 32-bit integers) of each row of docs.

    decoded: and the text that the ids decode to, from the same task. path: the vocabulary, where every executor finds it.
    """
    rows = docs.select("doc_id", *also, F.col("text").cast("string").alias("text"))
    kept = T.StructType([f for f in rows.schema if f.name != "text"])
    runs, names = class_runs(), [f.name for f in kept]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        encoder = Encoder(words, runs, special)  # its fragments go with the task, as the worker lives on
        for batch in (s for b in batches for s in slices(b, size=TOGETHER)):
            ids, first = encoder.column(*string_bytes(batch.column("text")))
            more = [pa.array(np.diff(first)), packed(ids.astype("<u4"), first)] + ([texts_of(words, ids, first)] if decoded else [])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *more], [*names, "n_tokens", "ids", "decoded"][: len(names) + len(more)])

    more = [("n_tokens", T.LongType()), ("ids", T.BinaryType()), ("decoded", T.StringType())]
    return rows.mapInArrow(encoded, _extended(kept, *(more if decoded else more[:2])))


def decode(rows: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """rows with `decoded`, the text of their ids; null ids have an empty text."""
    schema = rows.schema

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            sizes = np.array([len(x) if x is not None else 0 for x in batch.column(ids).to_pylist()], np.int64)
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), TOGETHER, "right")))
                part = batch.slice(at, to - at)
                raw = b"".join(x or b"" for x in part.column(ids).to_pylist())
                first = np.concatenate([[0], np.cumsum(sizes[at:to] // 4)])
                yield part.append_column("decoded", texts_of(words, np.frombuffer(raw, "<u4"), first))
                at = to

    return rows.mapInArrow(decoded, _extended(schema, ("decoded", T.StringType())))
