"""Queries register themselves here, each with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The same operators on a few literals: for the tests, no queries of the catalog.
FIXTURES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FIXTURE_ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, names=QUERIES, oracles=ORACLES):
    """Register a function (spark, read) -> DataFrame under its name; read(table) gives a table."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__doc__ = f.__doc__
        names[f.__name__] = run
        if oracle:
            oracles[f.__name__] = oracle
        return f

    return register


def fixture(oracle: str):
    """Register a function on literals, which reads no table."""
    return query(oracle, FIXTURES, FIXTURE_ORACLES)


def values(columns: str, *rows: str) -> str:
    """A table of literals, as SQL that Spark and the oracle both read."""
    return f"(SELECT * FROM (VALUES {', '.join(rows)}) AS t({columns}))"
