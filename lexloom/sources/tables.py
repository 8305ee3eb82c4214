"""The tracker's tables, with their schemas and defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns in order: type, and what stands where a row does not say.
TABLES = {
    "tracked_regulations": {"pcode": ("string", None), "name": ("string", None), "level": ("string", ""), "baseline_version": ("string", None), "baseline_date": ("string", None), "frequency_days": ("int", 7), "last_checked_at": ("string", None), "created_at": ("string", None)},
    "check_history": {"id": ("bigint", None), "pcode": ("string", None), "checked_at": ("string", None), "old_version": ("string", None), "new_version": ("string", None), "status": ("string", None), "summary_json": ("string", None)},
    "law_cache": {"key": ("string", None), "data_json": ("string", None), "fetched_at": ("string", None)},
}


def create(spark: SparkSession, database: str = "default") -> None:
    """Create those of the tables that are missing; what is there stays."""
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({', '.join(f'{c} {t}' for c, (t, _) in columns.items())}) USING parquet")


def fitted(rows: DataFrame, name: str) -> DataFrame:
    """rows with the table's columns and types; missing columns, and nulls where there is a default, are filled."""
    out = []
    for c, (kind, default) in TABLES[name].items():
        value = F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind)
        out.append((value if default is None else F.coalesce(value, F.lit(default))).alias(c))
    return rows.select(*out)


def append(rows: DataFrame, name: str, database: str = "default") -> None:
    fitted(rows, name).write.mode("append").insertInto(f"{database}.{name}")
