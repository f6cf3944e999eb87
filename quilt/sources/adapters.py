"""Graph and matrix relations derived from the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, val): orders by parts, quantity as the value; duplicates add."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("val")
    )


def input_vector(cols: DataFrame) -> DataFrame:
    """x(col) = col % 4 + 1 over the given column ids."""
    return cols.select("col", (F.col("col") % 4 + 1).cast("double").alias("x"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): successive parts of an order; a bag, parallel edges stay."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return (
        table(spark, sf_dir, "lineitem")
        .select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"))
        .where("dst IS NOT NULL")
    )


def nodes(edge: DataFrame, width: int = 100) -> DataFrame:
    """(n, sg): edge end points with the contiguous id range they fall in."""
    ends = edge.select(F.col("src").alias("n")).union(edge.select("dst")).distinct()
    return ends.select("n", F.expr(f"n div {width}").alias("sg"))


#: The same relations for DuckDB, to be put behind WITH.
MATRIX_SQL = "matrix AS (SELECT l_orderkey AS row, l_partkey AS col, l_quantity AS val FROM lineitem)"
EDGES_SQL = (
    "edges AS (SELECT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey "
    "ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst FROM lineitem) WHERE dst IS NOT NULL)"
)
NODES_SQL = "nodes AS (SELECT n, n // 100 AS sg FROM (SELECT src AS n FROM edges UNION SELECT dst FROM edges))"
