"""Stored tables that can change: insert-ignore, replace, delete and update, each as one commit.

A table is a folder. Its rows lie in parts (column `part`); a change writes the parts that it touches anew, into a folder
of its own, and leaves all others where they are. What belongs to the table is said by a numbered list, part by part,
under `_versions`; the next list is written beside and renamed to its number, which fails if another writer took
it. So readers see the old table or the new one, and a run that fails in between leaves the old one.

Parts are a hash of the key, or whatever a caller deals rows by. Only the numbers of parts and their folders pass through the driver: at most as many
as the table has parts. A table's change reads the touched parts once and shuffles the incoming rows to them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(Exception):
    """Another writer changed the table meanwhile; nothing was changed."""


class Stored:
    """A table under path, by key columns, in `parts` parts by a hash of the key unless rows bring their part."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: list[str], parts: int = 16):
        self.spark, self.path, self.key, self.parts = spark, path.rstrip("/"), key, parts
        self.schema = T.StructType([*schema.fields])
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ---- versions

    def version(self) -> int:
        """The number of the last commit; 0 before the first."""
        lists = self._path(f"{self.path}/_versions")
        if not self._files.exists(lists):
            return 0
        names = [f.getPath().getName() for f in self._files.listStatus(lists)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _places(self, version: int) -> dict[int, str]:
        """The folder of each part that has rows."""
        if not version:
            return {}
        found = self.spark.read.text(f"{self.path}/_versions/{version}", wholetext=True).first()
        return {int(p): f for p, f in json.loads(found[0]).items()}

    def _commit(self, version: int, places: dict[int, str]) -> None:
        draft, final = self._path(f"{self.path}/_versions/.{uuid.uuid4().hex}"), self._path(f"{self.path}/_versions/{version + 1}")
        out = self._files.create(draft)
        out.write(bytearray(json.dumps(places).encode()))
        out.close()
        if self._files.exists(final) or not self._files.rename(draft, final):
            self._files.delete(draft, False)
            raise Conflict(f"{self.path} has a version {version + 1} already")

    # ---- reading

    def read(self, parts: list[int] | None = None, version: int | None = None) -> DataFrame:
        """The rows with their part; of some parts only, or of an earlier version."""
        places = self._places(self.version() if version is None else version)
        wanted = [f"{self.path}/{f}/part={p}" for p, f in sorted(places.items()) if parts is None or p in set(parts)]
        whole = T.StructType([*self.schema.fields, T.StructField("part", T.IntegerType())])
        if not wanted:
            return self.spark.createDataFrame([], whole)
        out = None
        for folder in sorted({w.rsplit("/", 1)[0] for w in wanted}):
            rows = self.spark.read.schema(whole).option("basePath", folder).parquet(*[w for w in wanted if w.startswith(folder + "/")])
            out = rows if out is None else out.unionByName(rows)
        return out

    def rows(self) -> DataFrame:
        """The table as its users see it."""
        return self.read().drop("part")

    # ---- changing

    def parted(self, rows: DataFrame) -> DataFrame:
        """rows with the table's columns and the part of each."""
        part = F.col("part") if "part" in rows.columns else F.pmod(F.xxhash64(*self.key), F.lit(self.parts)).cast("int")
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema], part.alias("part"))

    def rewrite(self, touched: list[int], rows: DataFrame, version: int | None = None) -> None:
        """Let rows be all that the touched parts hold; version: the one that rows were made from."""
        version = self.version() if version is None else version
        folder = f"data-{uuid.uuid4().hex}"
        rows.hint("rebalance", F.col("part")).write.partitionBy("part").parquet(f"{self.path}/{folder}")  # a large part is several tasks and files
        names = [f.getPath().getName() for f in self._files.listStatus(self._path(f"{self.path}/{folder}"))]
        new = {int(n.split("=")[1]): folder for n in names if n.startswith("part=")}
        if not set(new) <= set(touched):
            raise ValueError("rows of parts that were not to be touched")
        old = self._places(version)
        self._commit(version, {p: f for p, f in old.items() if p not in set(touched)} | new)

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select("part").distinct().collect()]  # at most as many as there are parts

    def insert_ignore(self, rows: DataFrame) -> int:
        """Add the rows whose key is new, the first of each key in the order of all columns; how many those are."""
        return self._put(rows, lambda old, new: old.unionByName(new.join(old.select(*self.key), self._same(old, new), "left_anti")))

    def replace(self, rows: DataFrame) -> int:
        """Rows take the place of those with their key, the others are added; how many rows came."""
        before = self.version()
        self._put(rows, lambda old, new: old.join(new.select(*self.key), self._same(new, old), "left_anti").unionByName(new))
        return self._one_each(self.parted(rows)).count() if self.version() > before else 0

    def _same(self, a: DataFrame, b: DataFrame) -> Column:
        out = F.lit(True)
        for k in self.key:
            out = out & a[k].eqNullSafe(b[k])
        return out

    def _one_each(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.key).agg(F.min(F.struct(*[c for c in rows.columns if c not in self.key])).alias("_one")).select(*self.key, "_one.*")

    def _put(self, rows: DataFrame, change) -> int:
        version, new = self.version(), self._one_each(self.parted(rows))
        touched = self._touched(new)
        if not touched:
            return 0
        old = self.read(touched, version)
        before = old.count()
        self.rewrite(touched, change(old, new), version)
        return self.read(touched).count() - before

    def delete(self, condition: Column | str) -> int:
        """Take out the rows that meet a condition; how many those are."""
        return self._alter(condition, lambda rows, hit: rows.where(~hit))

    def update(self, condition: Column | str, values: dict[str, Column]) -> int:
        """Set columns, none of the key, of the rows that meet a condition; how many those are."""
        if set(values) & set(self.key):
            raise ValueError("a key cannot be updated")
        set_ = lambda rows, hit: rows.select(*[F.when(hit, values[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in values else F.col(f.name) for f in self.schema], "part")
        return self._alter(condition, set_)

    def _alter(self, condition: Column | str, change) -> int:
        hit = F.coalesce(F.expr(condition) if isinstance(condition, str) else condition, F.lit(False))
        version = self.version()
        met = {r[0]: r[1] for r in self.read(version=version).where(hit).groupBy("part").agg(F.count("*")).collect()}  # a row a part
        if met:
            self.rewrite(list(met), change(self.read(list(met), version), hit), version)
        return sum(met.values())

    def vacuum(self) -> int:
        """Delete what the last version does not need; how many folders and lists those are."""
        version = self.version()
        needed, gone = set(self._places(version).values()), 0
        for f in self._files.listStatus(self._path(self.path)):
            name = f.getPath().getName()
            if name.startswith("data-") and name not in needed:
                gone += bool(self._files.delete(f.getPath(), True))
        for f in self._files.listStatus(self._path(f"{self.path}/_versions")):
            if f.getPath().getName() != str(version):
                gone += bool(self._files.delete(f.getPath(), False))
        return gone
