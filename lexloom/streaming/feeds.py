"""Incremental versions: daily sync, quotas, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.operators import versions


def event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Zone-less timestamps as instants of the session's zone, which watermarks need."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Calls per day and user with a watermark; the quota counter over a stream or a batch."""
    return event_time(events).withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "user_id").agg(F.count("*").alias("used")).select(F.col("window.start").alias("day"), "user_id", "used")


def sliding_counts(events: DataFrame, width: str = "1 hour", step: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Calls in sliding windows, for rate limits."""
    return event_time(events).withWatermark("ts", late).groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("calls")).select(F.col("window.start").alias("start"), "event_type", "calls")


def once(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event id once: within the watermark of a stream, in all of a batch."""
    rows = event_time(events)
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else rows.dropDuplicates(["event_id"])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, calls): each user's calls that follow each other within the gap; of a stream, each session once, when the watermark has passed it."""
    rows = event_time(events).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("calls"))
    return rows.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "calls")


def followed(first: DataFrame, then: DataFrame, within: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, event_id, ts, then_id, then_ts): calls of first with each of then by the same user after them, within a time; both are streams or both batches.

    Watermarks and the time bound let a stream forget rows of first that nothing can follow any more.
    """
    a = event_time(first).withWatermark("ts", late).select("user_id", "event_id", "ts")
    b = event_time(then).withWatermark("ts", late).select(F.col("user_id").alias("u"), F.col("event_id").alias("then_id"), F.col("ts").alias("then_ts"))
    near = F.expr(f"user_id = u AND then_ts > ts AND then_ts <= ts + INTERVAL {within}")
    return a.join(b, near).drop("u")


def append(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Take all that has arrived and add what is final to the target's folder; a batch that is run again replaces its rows; then stop."""

    def batch(found: DataFrame, number: int) -> None:
        found.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return rows.writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dropped(query: StreamingQuery) -> int:
    """How many rows of a run came too late for its watermark."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def sync(index: DataFrame, tracked: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Take all index rows that have arrived, check the tracked laws against the latest of each, and write what the check found to the batch's own folder, so that a batch that is run again replaces its rows; then stop."""

    def batch(rows: DataFrame, number: int) -> None:
        newest = versions.latest(rows, ["pcode"], F.desc("current"))
        versions.check(tracked, newest).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return index.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
