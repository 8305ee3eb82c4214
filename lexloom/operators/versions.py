"""Versioned records: last row wins, retention, as-of, change detection, snapshot diff.

All take and return DataFrames; keys and orders are column names, so the same
operators serve regulations and any other versioned table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom import lexicon
from lexloom.functions import text as T
from lexloom.functions.udfs import char_diff


def latest(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def retain(versions: DataFrame, key: str, version: str, keep: int = 8) -> DataFrame:
    """The greatest `keep` versions of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(version))
    return versions.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep).drop("_rn")


def upsert(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """changes replace the rows of base with their key and add the others."""
    return base.join(changes.select(*key), key, "left_anti").unionByName(changes)


def insert_ignore(base: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is new are added."""
    return base.unionByName(rows.join(base.select(*key), key, "left_anti"))


def as_of(versions: DataFrame, moments: DataFrame, key: str, version: str, moment: str) -> DataFrame:
    """For each row of moments the greatest version up to its moment; null before the first.

    Versions and moments of a key stand in one order of time, and each moment takes the last version
    before it: one exchange, and no pairs of versions and moments.
    """
    both = moments.withColumn("_at", F.col(moment)).withColumn("_version", F.lit(None).cast(versions.schema[version].dataType)).withColumn("_asks", F.lit(1))
    known = versions.select(key, F.col(version).alias("_version")).withColumn("_at", F.col("_version")).withColumn("_asks", F.lit(0))
    w = Window.partitionBy(key).orderBy("_at", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    out = both.unionByName(known, allowMissingColumns=True).withColumn("as_of_version", F.last("_version", ignorenulls=True).over(w))
    return out.where("_asks = 1").select(*moments.columns, "as_of_version")


def check(tracked: DataFrame, index: DataFrame) -> DataFrame:
    """What a check finds: tracked(pcode, baseline) against index(pcode, current, abolished).

    missing, abolished, newly_tracked (no baseline), changed (a later version), unchanged.
    """
    both = tracked.join(index, "pcode", "left")
    status = (
        F.when(F.col("current").isNull(), "missing").when(F.col("abolished"), "abolished").when(F.col("baseline").isNull(), "newly_tracked")
        .when(F.col("current") > F.col("baseline"), "changed").otherwise("unchanged")
    )
    return both.withColumn("status", status).withColumn("changed", F.col("status") == "changed")


def next_baseline(checked: DataFrame) -> DataFrame:
    """The baselines after an official check: new and changed ones move to the current version."""
    moved = F.when(F.col("status").isin("newly_tracked", "changed"), F.col("current")).otherwise(F.col("baseline"))
    return checked.select("pcode", moved.alias("baseline"))


def history_rows(checked: DataFrame) -> DataFrame:
    """Only changed and unchanged checks go into the history."""
    return checked.where(F.col("status").isin("unchanged", "changed")).select("pcode", F.col("baseline").alias("old_version"), F.col("current").alias("new_version"), "status")


def diff_articles(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old and new have key, no, text: one row for each article with its kind; empty text counts as absent."""
    a = old.where(T.squeezed(F.col("text")) != "").select(*key, "no", F.col("text").alias("old"))
    b = new.where(T.squeezed(F.col("text")) != "").select(*key, "no", F.col("text").alias("new"))
    kind = (
        F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed")
        .when(T.squeezed(F.col("old")) == T.squeezed(F.col("new")), "unchanged").otherwise("modified")
    )
    return a.join(b, [*key, "no"], "full_outer").withColumn("kind", kind)


def with_operations(diff: DataFrame) -> DataFrame:
    """The character operations of modified articles; the alignment runs for these only."""
    changed = diff.where("kind = 'modified'").withColumn("ops", char_diff("old", "new"))
    rest = diff.where("kind != 'modified'").withColumn("ops", F.lit(None).cast("array<struct<t:string,s:string>>"))
    return changed.unionByName(rest)


def side(ops: str, kinds: tuple[str, str]) -> Column:
    """The text of one side of a diff: ('=', '-') is the old one, ('=', '+') the new one."""
    return F.array_join(F.transform(F.filter(ops, lambda o: o["t"].isin(*kinds)), lambda o: o["s"]), "")


def summary(ops: str, chars: int = 80) -> Column:
    """Additions and removals, cut, joined by bars."""
    shown = F.filter(ops, lambda o: o["t"] != "=")
    return F.array_join(F.transform(shown, lambda o: F.concat(o["t"], F.left(o["s"], F.lit(chars)))), " | ")


def last_amendment(history: Column) -> Column:
    """(doc_no, articles, full) of the last numbered entry of an amendment history; empty where none is numbered."""
    entries = F.split(history, r"\n\s*[0-9]+\.\s*")
    only = F.regexp_extract(history, r"(?s)[0-9]+\.\s*(.*)$", 1)
    last = F.when(F.size(entries) > 1, F.element_at(entries, -1)).otherwise(only)
    last = F.coalesce(F.regexp_replace(last, r"^\s+|\s+$", ""), F.lit(""))
    return F.struct(
        F.trim(F.regexp_extract(last, f"({lexicon.DOCUMENT_NUMBER})", 1)).alias("doc_no"),
        F.slice(F.array_distinct(F.regexp_extract_all(last, F.lit(lexicon.ARTICLE_RANGE), F.lit(1))), 1, 20).alias("articles"),
        F.left(last, F.lit(500)).alias("full"),
    )


def snapshot_rows(laws: DataFrame, key: str, column: str) -> DataFrame:
    """(key, version, article_no, text) of nested snapshot JSON; versions that begin with an underscore are internal."""
    rows = laws.select(key, F.explode(F.from_json(column, "map<string,map<string,string>>")).alias("version", "a")).where(~F.col("version").startswith("_"))
    return rows.select(key, "version", F.explode("a").alias("article_no", "text"))


def search(names: DataFrame, word: str, preferred_level: str) -> DataFrame:
    """names(name, level, …) matched in tiers: equal, beginning, anywhere; the preferred level first, then by name."""
    tier = F.when(F.col("name") == word, 0).when(F.col("name").startswith(word), 1).when(F.col("name").contains(word), 2)
    found = names.withColumn("tier", tier).where("tier is not null")
    return found.orderBy("tier", F.when(F.col("level") == preferred_level, 0).otherwise(1), "name")


def linked_hashes(rows: DataFrame, key: str, order: list[str], payload: str, first: str = "") -> DataFrame:
    """rows with hash and prev_hash, per key in order: each hash is of the one before (`first` at the beginning), a bar and the payload, so a change of one row changes all later hashes of its key.

    A chain is one sequence by nature: a key's rows go through one task, batch by batch, with the last hash carried along, so a
    task holds one batch whatever a key's number of rows. A null payload counts as empty.
    """
    schema = rows.schema

    def linked(batches):
        import hashlib

        import pyarrow as pa

        at, last = object(), first
        for batch in batches:
            before, own = [], []
            for k, text in zip(batch.column(key).to_pylist(), batch.column(payload).to_pylist(), strict=True):
                last = first if k != at else last
                at = k
                before.append(last)
                last = hashlib.sha256(f"{last}|{text or ''}".encode()).hexdigest()
                own.append(last)
            yield batch.append_column("hash", pa.array(own, pa.string())).append_column("prev_hash", pa.array(before, pa.string()))

    dealt = rows.repartition(key).sortWithinPartitions(key, *order)
    return dealt.mapInArrow(linked, type(schema)([*schema.fields]).add("hash", "string").add("prev_hash", "string"))


def hash_chain(rows: DataFrame, key: str, order: list[str], payload: Column) -> DataFrame:
    """hash and prev_hash per key in order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("hash", F.sha2(payload, 256)).withColumn("prev_hash", F.coalesce(F.lag("hash").over(w), F.lit("")))
