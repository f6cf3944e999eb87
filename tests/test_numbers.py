"""Scalar functions on keys and values that the small tables don't have."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quilt.functions import numbers as N

#: Keys about the largest k whose k * 6 * 10^14 a long holds (15372), and those of larger tables.
KEYS = [0, 1, 13705, 13706, 15372, 15373, 150_000, 9_000_000, 54_000_000, None]


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("orders"))
    rows = [(k, c, 100.0) for k in KEYS for c in (0, 1, 7, 5_400_000, None)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{d}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{d}/orders.parquet/*.parquet'")
    return d, con


@pytest.mark.parametrize("name", ["math_add", "math_sub", "math_mul", "math_mulo"])
def test_sums_and_products_that_no_long_holds(spark, orders, name):
    d, con = orders
    got = [(r.id, r.v) for r in __spark_entry__.queries()[name](spark, d).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, con.execute(__spark_entry__.oracle_sql()[name]).fetchall()))


def test_checked_longs(spark):
    rows = spark.createDataFrame([(N.MAX, 1), (N.MIN, -1), (N.MIN, 1), (5, -7), (None, 1)], "a long, b long")
    a, b = F.col("a"), F.col("b")
    got = rows.select(N.checked_add(a, b), N.checked_sub(a, b), N.checked_mul(a, b), N.overflows_mul(a, b)).collect()
    want = [(None, N.MAX - 1, N.MAX, False), (None, N.MIN + 1, None, True), (N.MIN + 1, None, N.MIN, False), (-2, 12, -35, False), (None, None, None, None)]
    assert [tuple(r) for r in got] == want
