"""Aggregates by day that merge to any period, without reading the rows again: distinct counts and quantiles as sketches.

A day's sketch has a fixed size whatever the day's rows (2**LOG_K buckets, or about K numbers by levels), is built before any exchange, and
merging is exact: the sketch of a period is that of its rows. Distinct counts are off by ERROR of their value (three standard deviations), ranks of
quantiles by RANK of the rows.

Defined cases: null values are not counted; a period without days has no row; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_K, K = 14, 800
ERROR, RANK = 3 * 1.04 / 2 ** (LOG_K / 2), 0.01


def daily(rows: DataFrame, day: str, keys: list[str], distinct: str, value: str) -> DataFrame:
    """keys, day, n, members (a distinct sketch) and spread (a quantile sketch) for each day."""
    return rows.groupBy(*keys, F.col(day).alias("day")).agg(
        F.count("*").alias("n"), F.hll_sketch_agg(F.col(distinct), LOG_K).alias("members"), F.kll_sketch_agg_double(F.col(value).cast("double"), K).alias("spread")
    )


def merged(days: DataFrame, keys: list[str], period: Column) -> DataFrame:
    """keys, period, n, and the sketches of the period."""
    return days.groupBy(*keys, period.alias("period")).agg(F.sum("n").alias("n"), F.hll_union_agg("members").alias("members"), F.kll_merge_agg_double("spread").alias("spread"))


def members(sketch: str) -> Column:
    return F.hll_sketch_estimate(sketch)


def quantile(sketch: str, share: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(share))
