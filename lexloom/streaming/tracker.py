"""The tracking run as a stream: each law's baseline lives in the stream's state, and survives restarts.

Index rows (pcode, seen, current, abolished) arrive in files. For each law and day the state says what a check finds: newly_tracked, changed
(a later version, which becomes the baseline), unchanged, abolished; and missing, once, when a law was not seen
for `every` days: by an event-time timeout, or at its next row, whichever comes first, so a restart changes nothing.
Laws are dealt to BUCKETS by a hash; a bucket's laws share one state row and one timeout, that of the law which is due first, so the
cost of a state is paid a bucket, and not for each of many laws with a few rows.

Defined cases: several rows of one law and day are one, of the greatest version, abolished if any is; rows of days before the law's last
are late: they change nothing and are reported as late, but for rows older than the watermark, which the stream drops; rows without
law or day are left out; a null version is the least.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVERY, LATE = 180, "1 day"
FOUND = "pcode string, at timestamp, old_version string, new_version string, status string"
#: Of a stream's whole life: a checkpoint is read with the number that it was made with.
BUCKETS = 1024
_STATE = "laws array<string>, baselines array<string>, last_ms array<long>, told array<boolean>"
_DAY_MS = 86_400_000


def _days(rows: DataFrame) -> DataFrame:
    return rows.where("pcode IS NOT NULL AND seen IS NOT NULL").select(F.col("pcode").cast("string").alias("pcode"), F.date_trunc("day", F.col("seen").cast("timestamp")).alias("seen"), F.coalesce(F.col("current").cast("string"), F.lit("")).alias("current"), F.coalesce("abolished", F.lit(False)).alias("abolished"))


def _follow(every: int):
    wait = every * _DAY_MS

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = {law: rest for law, *rest in zip(*state.get, strict=True)} if state.exists else {}
        out: list[tuple] = []
        laws: dict[str, dict[int, tuple[str, bool]]] = {}
        for batch in batches:  # a day is one entry, however many rows it has
            for law, day, current, gone in zip(batch["pcode"], batch["seen"].astype("datetime64[ms]").astype("int64").tolist(), batch["current"], batch["abolished"], strict=True):
                days = laws.setdefault(law, {})
                known = days.get(day, ("", False))
                days[day] = (max(known[0], current), known[1] or bool(gone))
        for law, days in laws.items():
            baseline, last, told = held.get(law, (None, None, False))
            for day in sorted(days):
                current, gone = days[day]
                if last is not None and day < last:
                    out.append((law, day, baseline, current, "late"))
                    continue
                if last is not None and day - last > wait and not told:
                    out.append((law, last + wait, baseline, None, "missing"))
                status = "abolished" if gone else "newly_tracked" if baseline is None else "changed" if current > baseline else "unchanged"
                out.append((law, day, baseline, current, status))
                last, told = day, False
                if status in ("newly_tracked", "changed"):
                    baseline = current
            held[law] = (baseline, last, told)
        passed, due = max(0, state.getCurrentWatermarkMs()), None
        for law, (baseline, last, told) in held.items():
            if told:
                continue
            if passed and last + wait + 1 < passed:
                out.append((law, last + wait, baseline, None, "missing"))
                held[law] = (baseline, last, True)
            else:
                due = last if due is None else min(due, last)
        state.update((list(held), *map(list, zip(*held.values(), strict=True))))
        if due is not None:
            state.setTimeoutTimestamp(max(due + wait + 1, passed + 1))
        if out:
            law, at, old, new, status = zip(*out, strict=True)
            yield pd.DataFrame({"pcode": law, "at": pd.to_datetime(list(at), unit="ms"), "old_version": old, "new_version": new, "status": status})

    return follow


def checks(index: DataFrame, every: int = EVERY, late: str = LATE) -> DataFrame:
    """(pcode, at, old_version, new_version, status) of a stream of index rows."""
    rows = _days(index).withWatermark("seen", late).withColumn("bucket", F.pmod(F.xxhash64("pcode"), F.lit(BUCKETS)))
    return rows.groupBy("bucket").applyInPandasWithState(_follow(every), FOUND, _STATE, "append", "EventTimeTimeout")


def run(index: DataFrame, target: str, checkpoint: str, every: int = EVERY, late: str = LATE) -> StreamingQuery:
    """Take all that has arrived, then stop; started again with the same checkpoint it goes on where it was. A batch that is run again replaces its rows."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return checks(index, every, late).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def found(spark: SparkSession, target: str) -> DataFrame:
    """What all runs have found."""
    return spark.read.schema(FOUND).option("basePath", target).parquet(f"{target}/batch=*").drop("batch")


def history(index: DataFrame, every: int = EVERY, late_days: int = 1) -> DataFrame:
    """What a stream of these index rows, in order of time, has found when its watermark has passed all; as one plan."""
    days = _days(index).groupBy("pcode", "seen").agg(F.max("current").alias("current"), F.bool_or("abolished").alias("abolished"))
    law = Window.partitionBy("pcode").orderBy("seen")
    before = law.rowsBetween(Window.unboundedPreceding, -1)
    rows = days.withColumn("old_version", F.max(F.when(~F.col("abolished"), F.col("current"))).over(before)).withColumn("next", F.lead("seen").over(law))
    status = F.when(F.col("abolished"), "abolished").when(F.col("old_version").isNull(), "newly_tracked").when(F.col("current") > F.col("old_version"), "changed").otherwise("unchanged")
    seen = rows.select("pcode", F.col("seen").alias("at"), "old_version", F.col("current").alias("new_version"), status.alias("status"))
    due = F.col("seen") + F.make_dt_interval(F.lit(every))
    end = days.agg((F.max("seen") - F.make_dt_interval(F.lit(late_days))).alias("end"))
    held = F.greatest("old_version", F.when(~F.col("abolished"), F.col("current")))
    gone = rows.join(F.broadcast(end)).where(due < F.coalesce("next", "end")).select("pcode", due.alias("at"), held.alias("old_version"), F.lit(None).cast("string").alias("new_version"), F.lit("missing").alias("status"))
    return seen.unionByName(gone)
