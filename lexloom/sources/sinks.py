"""Results as files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def csv(rows: DataFrame, path: str) -> None:
    """One CSV row per result row, with a header, added to what is there."""
    rows.write.mode("append").csv(path, header=True, quoteAll=False, escape='"')


def json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
