"""Overlap joins of intervals [start, end).

Where a key's pairs are few for its rows (at most FEW a row, and HOT rows), its intervals meet by the key alone: each travels once. Those of other keys meet by cells.
Each such interval has a level, the power of two that its length fits in, and lies in at most two cells of that level or
of any coarser one. Two intervals overlap only if they share a cell of the coarser one's level; so each gives one or two rows for
each level that occurs from its own on (at most 64), and rows of either side meet by an equi-join on key, level and cell.
An exact test follows, and a pair that meets in two cells is kept in the later. Long intervals so make no more rows than short ones,
and no pairs are made of intervals that are far apart.

A key with very many intervals is already split by its cells. Cells that are still hot on one side (more than HOT rows of one key) are split by a hash of
that side's rows, and the other side's rows of the cell are repeated for each split.

Defined cases: a null end is open, a null start begins before all; an interval without length overlaps nothing; null keys meet
nothing; touching intervals do not overlap; equal rows each meet; an empty side gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.sources.shared import checkpoint

HOT = 20_000
#: Pairs of a key for each of its rows up to which all are compared.
FEW = 64
#: Keys that are broadcast.
SIDE_ROWS = 100_000


def _level(start: str, end: str) -> Column:
    """The least n with end - start <= 2**n."""
    length = (F.col(end) - F.col(start)).cast("long")
    return F.when(length <= 1, 0).otherwise(F.length(F.bin(length - 1)))


def _cells(rows: DataFrame, key: list[str], levels: list[int]) -> DataFrame:
    """A row for each level from the interval's own on and each cell of it that the interval touches."""
    at = F.explode(F.filter(F.array(*[F.lit(n) for n in levels]), lambda n: n >= F.col("_level")))
    rows = rows.select(*key, "_row", "_start", "_end", "_level", at.alias("_at"))
    width = F.pow(F.lit(2.0), F.col("_at"))
    cells = F.sequence(F.floor(F.col("_start") / width), F.floor((F.col("_end") - 1) / width))
    return rows.select(*key, "_row", "_start", "_end", "_level", "_at", F.explode(cells).alias("_cell"))


def overlapping(left: DataFrame, right: DataFrame, key: list[str], start: str = "start", end: str = "end", hot: int = HOT, few: int = FEW) -> DataFrame:
    """(key…, l, r): all pairs of rows of left and right, as structs, with equal keys and overlapping [start, end), whole numbers or dates."""
    number = lambda c: F.unix_date(c) if dict(left.dtypes)[start] == "date" else F.col(c).cast("long")
    spans = []
    for rows in (left, right):
        spans.append(rows.select(*key, F.struct(*rows.columns).alias("_row"), number(start).alias("_start"), number(end).alias("_end")))
    spans = [x.where(" AND ".join(f"`{k}` IS NOT NULL" for k in key)) for x in spans]
    a, b = (x.select(*key, F.lit(int(k == 0)).cast("long").alias("_na"), F.lit(int(k == 1)).cast("long").alias("_nb")) for k, x in enumerate(spans))
    many = (F.col("_na") > 0) & (F.col("_nb") > 0) & ((F.col("_na") * F.col("_nb") > few * (F.col("_na") + F.col("_nb"))) | (F.col("_na") + F.col("_nb") > hot))
    dense = checkpoint(a.unionByName(b).groupBy(*key).agg(F.sum("_na").alias("_na"), F.sum("_nb").alias("_nb")).where(many).select(*key))
    n = dense.count()
    if not n:
        return _by_key(*spans, key)
    dense = F.broadcast(dense) if n <= SIDE_ROWS else dense
    return _by_key(*(x.join(dense, key, "left_anti") for x in spans), key).unionByName(_by_cells([x.join(dense, key, "left_semi") for x in spans], key, hot))


def _by_key(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    least, most = F.lit(-(2**63)), F.lit(2**63 - 1)
    a, b = (x.withColumn("_start", F.coalesce("_start", least)).withColumn("_end", F.coalesce("_end", most)).where("_end > _start") for x in (a, b))
    b = b.withColumnsRenamed({"_row": "_row_b", "_start": "_start_b", "_end": "_end_b"})
    met = a.join(b, key).where((F.col("_start") < F.col("_end_b")) & (F.col("_start_b") < F.col("_end")))
    return met.select(*key, F.col("_row").alias("l"), F.col("_row_b").alias("r"))


def _by_cells(spans: list[DataFrame], key: list[str], hot: int) -> DataFrame:
    edges = spans[0].select("_start", "_end").unionByName(spans[1].select("_start", "_end")).agg(F.least(F.min("_start"), F.min("_end")).alias("low"), F.greatest(F.max("_start"), F.max("_end")).alias("high")).first()
    low, high = (edges.low or 0) - 1, (edges.high or 0) + 1
    spans = [x.withColumn("_start", F.coalesce("_start", F.lit(low))).withColumn("_end", F.coalesce("_end", F.lit(high))).where("_end > _start").withColumn("_level", _level("_start", "_end")) for x in spans]
    levels = sorted(r[0] for r in spans[0].select("_level").union(spans[1].select("_level")).distinct().collect())  # 64 at most
    a, b = (_cells(x, key, levels) for x in spans)
    place = [*key, "_at", "_cell"]
    cuts = lambda x, name: x.groupBy(*place).agg(F.ceil(F.count("*") / hot).alias(name)).where(F.col(name) > 1)
    splits = cuts(a, "_na").join(cuts(b, "_nb"), place, "full_outer")
    a, b = (x.join(splits, place, "left").withColumn("_na", F.coalesce("_na", F.lit(1))).withColumn("_nb", F.coalesce("_nb", F.lit(1))) for x in (a, b))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("_row", "_start"), F.col(n))
    a = a.withColumn("_sa", mine("_na")).withColumn("_sb", every("_nb")).drop("_na", "_nb")
    b = b.withColumn("_sb", mine("_nb")).withColumn("_sa", every("_na")).drop("_na", "_nb")
    b = b.withColumnsRenamed({"_row": "_row_b", "_start": "_start_b", "_end": "_end_b", "_level": "_level_b"})
    met = a.join(b, [*place, "_sa", "_sb"]).where((F.col("_at") == F.greatest("_level", "_level_b")) & (F.col("_start") < F.col("_end_b")) & (F.col("_start_b") < F.col("_end")))
    met = met.where(F.col("_cell") == F.floor(F.greatest("_start", "_start_b") / F.pow(F.lit(2.0), F.col("_at"))))
    return met.select(*key, F.col("_row").alias("l"), F.col("_row_b").alias("r"))
