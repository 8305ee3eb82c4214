"""Shared pieces: keys, checkpoints, and word hashing over whole Arrow columns.

The word hashing works on the bytes of an Arrow string column, a slice of
about half a megabyte at a time, which keeps its arrays in the processor's cache, so a task needs memory for one slice (or one
document, if that is longer) and not for its whole partition.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.sources.shared import checkpoint as shared_checkpoint  # noqa: F401  the operators take both from here
from lexloom.sources.shared import folder as shared_folder  # noqa: F401

U = np.uint64
SLICE_BYTES = 1 << 19

#: The bytes between words: space, and tab to carriage return.
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True

_BASE = 0x9E3779B97F4A7C15
_GRAM = 0xD1342543DE82EF95
_BYTES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that was written by Spark, wherever it is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run meanwhile hand so many rows at once to Python, for rows that are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def keyed(docs: DataFrame, *also: str) -> DataFrame:
    """The columns an operator needs, and a key that survives null and repeated ids.

    Two rows share (_id, _t) only if both their id and their text agree, and
    then every operator here gives both the same result.
    """
    number, told = F.col("doc_id").cast("long"), []
    if not isinstance(docs.schema["doc_id"].dataType, (T.IntegralType, T.NullType)):  # ids that are no whole numbers go by their hash
        number = F.coalesce(F.col("doc_id").cast("string").try_cast("long"), F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("string"))))
        told = [F.col("doc_id").cast("string")]
    return docs.select(
        "doc_id",
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        *also,
        F.coalesce(number, F.lit(-(2**63) + 1)).alias("_id"),
        F.xxhash64(F.col("text"), F.col("doc_id").isNull(), *told).alias("_t"),
    )


KEY = ["_id", "_t"]


def whole(docs: DataFrame) -> DataFrame:
    """docs with all columns, whatever their names, in one more, the struct _row; select("_row.*") gives them back."""
    return docs.withColumn("_row", F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]))


def carried(docs: DataFrame) -> DataFrame:
    """key and _row of each row."""
    return keyed(whole(docs), "_row").select(*KEY, "_row")


def renewed(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The columns of docs from rows of _row, without its text, and a new text; n_chars follows the text."""
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[(new[c] if c in new else F.col("_row").getField(c)).alias(c) for c in docs.columns])


def sha256_of(column: Column) -> Column:
    return F.sha2(F.encode(column, "UTF-8"), 256)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a bijection."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


class _Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, as far as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << int(n - 1).bit_length()
            self.up, self.down = (np.cumprod(np.concatenate([[U(1)], np.full(size - 1, U(b), U)]), dtype=U) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_byte_powers, _gram_powers = _Powers(_BASE), _Powers(_GRAM)


class Polynomial:
    """Hashes of any ranges of a sequence of 64-bit values, from one prefix sum."""

    def __init__(self, values: np.ndarray, powers: _Powers = _gram_powers):
        up, self._down = powers.upto(len(values) + 1)
        self._sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * up[: len(values)], out=self._sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._down[start])

    def windows(self, n: int) -> np.ndarray:
        """Of each n neighbours, by the place of the first."""
        m = max(0, len(self._sums) - n)
        return mix((self._sums[n : n + m] - self._sums[:m]) * self._down[:m])


class Words:
    """The words of some documents.

    hash: of each word; start, end: its bytes in data; first: the number of
    words before each document, with the total at the end; bytes: the same for
    bytes.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = False, blank: np.ndarray = BLANK):
        self.data, self.bytes = data, offsets
        if not blank.all():
            edge = np.empty(len(data) + 1, bool)
            word = ~blank[data]
            edge[:-1] = word
            edge[-1:] = False
            before = np.zeros(len(data) + 1, bool)
            before[1:] = word
            cuts = offsets[(offsets > 0) & (offsets < len(data))]
            starts = edge & ~before
            ends = before & ~edge
            both = cuts[edge[cuts] & before[cuts]]
            starts[both] = True
            ends[both] = True
            self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, offsets).astype(np.int64)
        self.count = np.diff(self.first)
        self.fold = fold

    _poly: Polynomial | None = None

    @property
    def poly(self) -> Polynomial:
        """Over the bytes."""
        if self._poly is None:
            self._poly = Polynomial((_FOLDED if self.fold else _BYTES)[self.data], _byte_powers)
        return self._poly

    @property
    def hash(self) -> np.ndarray:
        return self.poly.hashes(self.start, self.end)

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def room(self) -> np.ndarray:
        """Words from each word to the end of its document, itself included."""
        return np.repeat(self.first[1:], self.count) - np.arange(self.first[-1])


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def slices(batch: pa.RecordBatch, column: str = "text", rows: int = 1 << 16, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about `size` bytes of the column and at most so many rows; rows stay whole."""
    _, o = string_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = min(at + rows, max(at + 1, int(np.searchsorted(o, o[at] + size, "right")) - 1))
        yield batch.slice(at, to - at)
        at = to


def words_of(batch: pa.RecordBatch, column: str = "text", fold: bool = False, blank: np.ndarray = BLANK) -> Words:
    return Words(*string_bytes(batch.column(column)), fold, blank)


def squeezed(rows: DataFrame) -> DataFrame:
    """rows with the text as a zstd frame, to exchange half the bytes."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
        for batch in (s for b in batches for s in slices(b)):
            raw, o = string_bytes(batch.column("text"))
            raw = raw.tobytes()
            packed = pa.array([pack(raw[a:b]) for a, b in zip(o[:-1], o[1:], strict=True)], pa.binary())
            yield batch.set_column(batch.schema.get_field_index("text"), "text", packed)

    types = ", ".join(f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(squeeze, types)


def unsqueezed(batches: Iterator[pa.RecordBatch], also: str = "") -> Iterator[pa.RecordBatch]:
    """Batches with their texts back, a few hundred rows at a time; also: the name under which the frames stay."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
        at = batch.schema.get_field_index("text")
        if pa.types.is_binary(batch.schema.field(at).type):
            batch = batch.append_column(also, batch.column(at)) if also else batch
            texts = pa.array([unpack(x) for x in batch.column(at).to_pylist()], pa.binary())
            batch = batch.set_column(at, "text", texts.cast(pa.string()))
        yield batch


def signed(x: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark's long."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def ragged(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A list column from all its values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


@cache
def vocabulary():
    """The byte-level vocabulary, once in a Python worker."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})


def take(batch: pa.RecordBatch, names: list[str], at: np.ndarray) -> list[pa.Array]:
    index = pa.array(at)
    return [batch.column(n).take(index) for n in names]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
