"""Every query of the library against its SQL oracle, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from lexloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    try:
        x = float(v)
    except (TypeError, ValueError):
        return str(v)
    return "nan" if math.isnan(x) else f"{x:.8g}" if not isinstance(v, str) else v


def rows(columns, found):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(repr([plain(r[k]) for k in order]) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES | catalog.FIXTURES))
def test_against_oracle(spark, duck, name):
    df = (catalog.QUERIES | catalog.FIXTURES)[name](spark, SF)
    want = duck.execute((catalog.ORACLES | catalog.FIXTURE_ORACLES)[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


def test_the_mode_is_computed(spark, duck):
    found = {r.dimension: r.typical for r in catalog.QUERIES["a21_typical_dimension"](spark, SF).collect()}
    assert found and found == dict(duck.execute(catalog.ORACLES["a21_typical_dimension"]).fetchall())


def test_every_query_has_an_oracle_and_the_flagship_runs(spark):
    assert set(catalog.QUERIES) == set(catalog.ORACLES) and set(catalog.FIXTURES) == set(catalog.FIXTURE_ORACLES)
    assert not set(catalog.FIXTURES) & set(__spark_entry__.queries())
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(catalog.ORACLES) <= set(__spark_entry__.oracle_sql())
    assert __spark_entry__.entry(spark).count() > 0


def test_first_of_equal_versions_is_the_first_row(spark, tmp_path):
    """S9 on rows that repeat an order and a line: the one that stands first, however the rows are dealt to tasks."""
    n = 20_000
    duckdb.execute(f"COPY (SELECT k % 97 AS l_orderkey, k // 97 % 2 AS l_linenumber, 'f' || k AS l_returnflag, 'O' AS l_linestatus FROM range({n}) t(k) ORDER BY hash(k)) TO '{tmp_path}/lineitem.parquet' (ROW_GROUP_SIZE 2048)")
    duckdb.execute(f"COPY (SELECT k AS o_orderkey FROM range(97) t(k)) TO '{tmp_path}/orders.parquet'")
    want = {}
    for key, line, flag in duckdb.execute(f"SELECT l_orderkey, l_linenumber, l_returnflag FROM read_parquet('{tmp_path}/lineitem.parquet', file_row_number = true) ORDER BY file_row_number").fetchall():
        if line == 0:
            want.setdefault(key, (key, 0, flag + "O"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert sorted(map(tuple, catalog.QUERIES["s9_first_version"](spark, str(tmp_path)).collect())) == sorted(want.values())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
