"""Operator 12, hard-negative mining by a two-dimensional block matrix multiply.

Every row is scored against every anchor (a fixed share of the ids) as in SUMMA: rows are dealt to blocks of about
ROWS, anchors to blocks of about ANCHORS, and both are cut into chunks of CHUNK dimensions. A task multiplies one block of
anchors with one block of rows over one chunk; the partial int64 tiles of all chunks are shuffled to the place of their tile and added.
Each tile is then reduced twice. First to the best `positives` rows of each anchor's label, whose best over all
tiles are the anchor's positives. Each positive opens a window of scores; then each tile gives the first `most` rows of
other labels inside each window, and the first over all tiles are the result. So of rows x anchors scores none leaves its tile but a few
for each tile and window.

Tiles travel in the narrowest integer type that holds them, byte by byte as zstd frames, and are checkpointed between the two
reductions. Blocks are dealt by a hash of the id, so neither a label nor a
run of ids makes a large block. Products are taken in floating point where all sums stay exact, else as 64-bit integers.

Defined cases: rows without id, label or vector, or with a null or non-finite component, take no part; of
rows that repeat an id the one with the least label and vector stands; a shorter vector counts as followed by zeros; components saturate at
2**53 and scores wrap at 64 bits; equal scores go by the smaller id; an anchor without positives or without
rows in a window has no rows; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_checkpoint

#: Rows, anchors and dimensions of a partial tile, about.
ROWS, ANCHORS, CHUNK = 4096, 256, 32
SCALE, EVERY, POSITIVES, MOST = 256, 100, 5, 10
#: A negative's score in percent of its positive's.
LOW, HIGH = 30, 90
LARGEST = 2**53


def usable(rows: DataFrame, label: Column) -> DataFrame:
    """vec_id, label and v (floor(SCALE * x) of each component) of the rows that take part, one for each id."""
    x = lambda c: F.floor(c.cast("double") * SCALE)
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    some = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    bound = F.lit(float(LARGEST))
    v = F.transform("embedding", lambda c: F.least(F.greatest(c.cast("double"), -bound / SCALE), bound / SCALE))
    some = some.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(v, x).alias("v"))
    return some.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("one")).select("vec_id", "one.*")


def packed_tile(tile: np.ndarray) -> bytes:
    """A tile of integers in the narrowest type that holds it, its bytes sorted by their place."""
    import zstandard

    low, high = (int(tile.min()), int(tile.max())) if tile.size else (0, 0)
    kind = next(t for t in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    planes = np.ascontiguousarray(tile.astype(kind).reshape(-1, 1).view(np.uint8).T)
    return kind[2:].encode() + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked_tile(raw: bytes, shape: tuple[int, int]) -> np.ndarray:
    import zstandard

    width = int(raw[:1])
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<i{width}").reshape(shape).astype(np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int64, exact modulo 2**64."""
    most = lambda x: max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    if most(a) * most(b) * max(1, a.shape[1]) < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of integers as rows, zeros behind the shorter."""
    lists = column.combine_chunks()
    lengths = lists.value_lengths().to_numpy()
    out = np.zeros((len(lengths), int(lengths.max()) if len(lengths) else 0), np.int64)
    out[np.arange(out.shape[1])[None] < lengths[:, None]] = lists.flatten().to_numpy()
    return out


def _longs(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


_TILE = "i int, j int, k int, anchors array<long>, anchor_labels array<long>, ids array<long>, labels array<long>, tile binary"
_LISTS = ("anchors", "anchor_labels", "ids", "labels")
_TILE_ROWS = pa.schema([*((c, pa.int32()) for c in "ijk"), *((c, pa.list_(pa.int64())) for c in _LISTS), ("tile", pa.binary())])


def _partial(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """One block of anchors times one block of rows over one chunk."""
    if not (len(anchors) and len(rows)):
        return _TILE_ROWS.empty_table()
    order = [np.argsort(_longs(t, "vec_id")) for t in (anchors, rows)]
    both = [_matrix(t.column("v"))[o] for t, o in zip((anchors, rows), order, strict=True)]
    width = max(m.shape[1] for m in both)
    tile = product(*(np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in both))
    i, j, k = (anchors.column(c)[0].as_py() for c in ("i", "j", "k"))
    told = [_longs(t, c)[o] if k == 0 else [] for t, o in zip((anchors, rows), order, strict=True) for c in ("vec_id", "label")]  # ids travel once
    return pa.table([pa.array([x], kind) for x, kind in zip((i, j, k, *told, packed_tile(tile)), _TILE_ROWS.types, strict=True)], _TILE_ROWS)


def _ids_of(parts: pa.Table) -> list[np.ndarray]:
    """The lists of ids and labels, from the part of chunk 0."""
    at = int(np.argmin(_longs(parts, "k"))) if "k" in parts.column_names else 0
    return [parts.column(c)[at].values.to_numpy() for c in _LISTS]


def _added(positives: int):
    """The partial tiles of one place: their sum, and its best rows of each anchor's label."""

    def added(parts: pa.Table) -> pa.Table:
        anchors, anchor_labels, ids, labels = _ids_of(parts)
        tile = np.zeros((len(anchors), len(ids)), np.int64)
        for raw in parts.column("tile"):
            tile += unpacked_tile(raw.as_py(), tile.shape)
        near = []
        for n, anchor in enumerate(anchors.tolist()):
            same = np.flatnonzero((labels == anchor_labels[n]) & (ids != anchor))
            best = same[np.lexsort((ids[same], ~tile[n, same]))[:positives]]
            near += [{"anchor_id": anchor, "positive_id": p, "positive_score": s} for p, s in zip(ids[best].tolist(), tile[n, best].tolist(), strict=True)]
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("anchor_id", "positive_id", "positive_score")]))
        one = parts.slice(int(np.argmin(_longs(parts, "k"))), 1).drop_columns(["k", "tile"])
        return one.append_column("tile", pa.array([packed_tile(tile)], pa.binary())).append_column("near", pa.array([near], kind))

    return added


def _mined(most: int, low: int, high: int):
    """The first rows of other labels in each window of a tile's anchors."""
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]

    def mined(tiles: pa.Table, windows: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in names]
        if len(tiles) and len(windows):
            anchors, anchor_labels, ids, labels = _ids_of(tiles)
            tile = unpacked_tile(tiles.column("tile")[0].as_py(), (len(anchors), len(ids)))
            order = np.argsort(_longs(windows, "anchor_id"))
            anchor, positive, score = (_longs(windows, c)[order] for c in names[:3])
            for n, one in enumerate(anchors.tolist()):
                others = np.flatnonzero(labels != anchor_labels[n])
                others = others[np.lexsort((ids[others], ~tile[n, others]))]
                scores = tile[n, others]
                for at in range(*np.searchsorted(anchor, [one, one + 1])):
                    p = int(score[at])
                    # 100 * s between low * p and high * p, from the highest down
                    begin = int(np.searchsorted(~scores, ~(high * p // 100), "left"))
                    end = int(np.searchsorted(~scores, ~-(-low * p // 100), "right"))
                    own = slice(begin, max(begin, min(end, begin + most)))
                    for x, values in zip(found, (anchor[at], positive[at], p, ids[others[own]], scores[own]), strict=True):
                        x.append(np.broadcast_to(values, (own.stop - own.start,)))
        return pa.table({c: np.concatenate(x) for c, x in zip(names, found, strict=True)})

    return mined


def _anew(rows: DataFrame) -> DataFrame:
    """rows as columns of their own: both sides of a cogroup stem from one table."""
    return rows.select(*[F.col(c).alias(c) for c in rows.columns])


def mine(
    rows: DataFrame, label: Column | None = None, every: int = EVERY, positives: int = POSITIVES, most: int = MOST, low: int = LOW, high: int = HIGH,
    block: int = ROWS, anchor_block: int = ANCHORS, chunk: int = CHUNK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by `every`; label: in place of the column label.
    """
    all_rows = shared_checkpoint(usable(rows, F.col("label") if label is None else label))
    is_anchor = F.col("vec_id") % every == 0
    size = all_rows.agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("anchors"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width")).first()
    down, across, deep = (max(1, math.ceil(n / at)) for n, at in ((size.anchors, anchor_block), (size.n, block), (size.width, chunk)))

    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), n).cast("int")
    cut = all_rows.select("vec_id", "label", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(deep - 1)), lambda k: F.slice("v", k * chunk + 1, chunk))).alias("k", "v"))
    left = cut.where(is_anchor).select(dealt(down, 1).alias("i"), number(across).alias("j"), "k", "vec_id", "label", "v")
    right = cut.select(number(down).alias("i"), dealt(across, 2).alias("j"), "k", "vec_id", "label", "v")
    place = ["i", "j", "k"]
    parts = left.groupBy(*place).cogroup(_anew(right).groupBy(*place)).applyInArrow(_partial, _TILE)
    tiles = parts.groupBy("i", "j").applyInArrow(_added(positives), f"{_TILE.replace(' k int,', '')}, near array<struct<anchor_id:long,positive_id:long,positive_score:long>>")
    tiles = shared_checkpoint(tiles)

    first = lambda keys, score, other, n: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), other)) <= n
    near = tiles.select("i", F.explode("near").alias("x")).select("i", "x.*")
    near = near.withColumn("ok", first(["anchor_id"], "positive_score", "positive_id", positives)).where("ok").drop("ok")
    windows = near.select("i", number(across).alias("j"), "anchor_id", "positive_id", "positive_score")
    found = tiles.drop("near").groupBy("i", "j").cogroup(_anew(windows).groupBy("i", "j")).applyInArrow(_mined(most, low, high), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
