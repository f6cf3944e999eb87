"""Sparse matrix queries: products, tilings, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quilt.operators import tiling as T
from quilt.sources import adapters as A

#: Tile grid of the queries.
H, V, SPLITS, WORKERS = 16, 16, 8, 64
#: Extent of the matrix, and tile sizes from it, for DuckDB.
_DIM = "dim AS (SELECT (max(row) + 1 + 15) // 16 AS h, (max(col) + 1 + 15) // 16 AS w, (max(col) + 1 + 1) // 2 AS w2, max(row) + 1 AS n FROM matrix)"
_TILED = f"WITH {A.MATRIX_SQL}, {_DIM}, tiled AS (SELECT row, col, val, (row // h) * {V} + col // w AS p, row % h AS local_row, col % w AS local_col FROM matrix, dim)"
_VERT = f"WITH {A.MATRIX_SQL}, {_DIM}, vert AS (SELECT row, col, val, col // w2 AS vert FROM matrix, dim)"
_Y = "SELECT row, sum(val * (col % 4 + 1)) AS y FROM matrix GROUP BY row"


def _sizes(m):
    rows, cols = T.extent(m)
    return rows, cols, -(-rows // H), -(-cols // V), -(-cols // 2)


def grid(m):
    """Height and width of the tiles."""
    return _sizes(m)[2:4]


def _x(m):
    return A.input_vector(m.select("col").distinct())


def _tiles(spark, d):
    m = A.matrix(spark, d)
    _, _, h, w, _ = _sizes(m)
    return m, T.tiled(m, h, w, V)


def spmv_plain(spark, d):
    m = A.matrix(spark, d)
    return T.spmv(m, _x(m))


def spmv_tiled(spark, d):
    m, t = _tiles(spark, d)
    return T.spmv(t, _x(m), "p")


def spmv_vertical(spark, d):
    m = A.matrix(spark, d)
    return T.spmv(T.vertical(m, _sizes(m)[4]), _x(m), "vert")


def spmv_dense_rows(spark, d):
    m = A.matrix(spark, d)
    return T.dense(T.spmv(m, _x(m)), _sizes(m)[0])


def spmv_verify(spark, d):
    found = T.differences(spmv_plain(spark, d), spmv_tiled(spark, d))
    return found.select("n_rows", "n_wrong", F.col("sum_a").cast("long").alias("sum_a"), F.col("sum_b").cast("long").alias("sum_b"))


def input_vector(spark, d):
    return _x(A.matrix(spark, d))


def coo_sorted_rowcount(spark, d):
    return A.matrix(spark, d).groupBy("row").agg(F.count("*").alias("nnz")).orderBy("row")


def tile_histogram(spark, d):
    return _tiles(spark, d)[1].groupBy("p").agg(F.count("*").alias("nnz"))


def tile_rowptr(spark, d):
    return T.row_pointers(_tiles(spark, d)[1], "p", "local_row").select("p", "local_row", "nnz", "ends")


def vtile_rowptr(spark, d):
    m = A.matrix(spark, d)
    return T.row_pointers(T.vertical(m, _sizes(m)[4]), "vert", "row").select("vert", "row", "nnz", "starts")


def _descriptors(spark, d):
    t = _tiles(spark, d)[1].groupBy("p").agg(F.count("*").alias("nnz"), F.countDistinct("local_row").alias("n_rows"))
    upto = T.Window.orderBy("p").rowsBetween(T.Window.unboundedPreceding, -1)  # one row for each tile: H * V at most
    return t.withColumn("start_idx", F.coalesce(F.sum("nnz").over(upto), F.lit(0)))


def tile_descriptors(spark, d):
    return _descriptors(spark, d).withColumn("padded", F.expr("(nnz + 1) div 2 * 2"))


def tile_max(spark, d):
    return _descriptors(spark, d).agg(F.max("nnz").alias("max_nnz"), F.max("n_rows").alias("max_rows"), F.sum("nnz").alias("total_nnz"))


def _vert_counts(spark, d):
    m = A.matrix(spark, d)
    return T.vertical(m, _sizes(m)[4]).groupBy(F.col("vert").alias("tile"), "row").agg(F.count("*").alias("nnz"))


def nnz_split(spark, d):
    return T.nnz_splits(_vert_counts(spark, d), SPLITS)


def worker_split(spark, d):
    return T.nnz_splits(_vert_counts(spark, d), SPLITS, granularity=2)


def even_row_split(spark, d):
    m = A.matrix(spark, d)
    return T.even_split(m.select("row").distinct(), _sizes(m)[0], WORKERS)


def spmv_load_balanced(spark, d):
    """Partial sums per vertical tile and nnz-balanced block, then merged."""
    m = A.matrix(spark, d)
    v = T.vertical(m, _sizes(m)[4])
    splits = nnz_split(spark, d).select("tile", "block", "row_lo", "row_hi")
    placed = v.join(F.broadcast(splits), (v["vert"] == splits["tile"]) & (v["row"] >= splits["row_lo"]) & (v["row"] <= splits["row_hi"]))
    part = placed.join(_x(m), "col").groupBy("vert", "block", "row").agg(F.sum(F.col("val") * F.col("x")).alias("v"))
    return part.groupBy("row").agg(F.sum("v").alias("y"))


def matrix_equal(spark, d):
    """A tiled matrix against its source, put together again from tile-local ids, and one that lost its last tile."""
    m, t = _tiles(spark, d)
    h, w = grid(m)
    back = t.where(f"p <> {H * V - 1}").selectExpr(f"p div {V} * {h} + local_row AS row", f"p % {V} * {w} + local_col AS col", "val")
    whole = m.groupBy("row", "col").agg(F.sum("val").alias("val"))
    return T.compared(whole, back.groupBy("row", "col").agg(F.sum("val").alias("val")))


def _split_sql(even: bool) -> str:
    behind = " AND (c.row + 1) % 2 = 0" if even else ""
    return f"""{_VERT.replace('WITH ', 'WITH RECURSIVE ', 1)},
c0 AS (SELECT vert, row, count(*) AS nnz FROM vert GROUP BY vert, row),
c AS (SELECT *, row_number() OVER (PARTITION BY vert ORDER BY row) AS k, sum(nnz) OVER (PARTITION BY vert) // {SPLITS} AS lim FROM c0),
go(vert, k, row, nnz, held, block) AS (
  SELECT vert, k, row, nnz, CAST(0 AS HUGEINT), 0 FROM c WHERE k = 0
  UNION ALL SELECT vert, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS HUGEINT), 0 FROM (SELECT DISTINCT vert FROM c)
  UNION ALL SELECT c.vert, c.k, c.row, c.nnz,
    CASE WHEN g.held + c.nnz >= c.lim AND g.block < {SPLITS - 1}{behind} THEN 0 ELSE g.held + c.nnz END,
    CASE WHEN g.held + c.nnz >= c.lim AND g.block < {SPLITS - 1}{behind} THEN g.block + 1 ELSE g.block END
  FROM go g JOIN c ON c.vert = g.vert AND c.k = g.k + 1),
dealt AS (SELECT vert, row, nnz, coalesce(lag(block) OVER (PARTITION BY vert ORDER BY k), 0) AS block, k FROM go)
SELECT vert AS tile, block, min(row) AS row_lo, max(row) AS row_hi, CAST(sum(nnz) AS BIGINT) AS nnz FROM dealt WHERE k > 0 GROUP BY vert, block"""


_SPLIT = {e: _split_sql(e).replace("  SELECT vert, k, row, nnz, CAST(0 AS HUGEINT), 0 FROM c WHERE k = 0\n  UNION ALL SELECT vert, CAST(0", "  SELECT vert, CAST(0") for e in (False, True)}
_DESC = f"{_TILED}, t AS (SELECT p, count(*) AS nnz, count(DISTINCT local_row) AS n_rows FROM tiled GROUP BY p), desc_ AS (SELECT *, CAST(coalesce(sum(nnz) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_idx FROM t)"

QUERIES = {f.__name__: f for f in (spmv_plain, spmv_tiled, spmv_vertical, spmv_dense_rows, spmv_verify, spmv_load_balanced, input_vector, coo_sorted_rowcount, tile_histogram, tile_rowptr, vtile_rowptr, tile_descriptors, tile_max, nnz_split, worker_split, even_row_split, matrix_equal)}
ORACLES = {
    **dict.fromkeys(("spmv_plain", "spmv_tiled", "spmv_vertical", "spmv_load_balanced"), f"WITH {A.MATRIX_SQL} {_Y}"),
    "spmv_dense_rows": f"WITH {A.MATRIX_SQL}, y AS ({_Y}) SELECT r.range AS row, coalesce(y, 0.0::DOUBLE) AS y FROM range(0, (SELECT max(row) + 1 FROM matrix)) r LEFT JOIN y ON y.row = r.range",
    "spmv_verify": f"WITH {A.MATRIX_SQL}, y AS ({_Y}) SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_wrong, CAST(sum(y) AS BIGINT) AS sum_a, CAST(sum(y) AS BIGINT) AS sum_b FROM y",
    "input_vector": f"WITH {A.MATRIX_SQL} SELECT DISTINCT col, CAST(col % 4 + 1 AS DOUBLE) AS x FROM matrix",
    "coo_sorted_rowcount": f"WITH {A.MATRIX_SQL} SELECT row, count(*) AS nnz FROM matrix GROUP BY row",
    "tile_histogram": f"{_TILED} SELECT p, count(*) AS nnz FROM tiled GROUP BY p",
    "tile_rowptr": f"{_TILED}, c AS (SELECT p, local_row, count(*) AS nnz FROM tiled GROUP BY p, local_row) SELECT p, local_row, nnz, CAST(sum(nnz) OVER (PARTITION BY p ORDER BY local_row) AS BIGINT) AS ends FROM c",
    "vtile_rowptr": f"{_VERT}, c AS (SELECT vert, row, count(*) AS nnz FROM vert GROUP BY vert, row) SELECT vert, row, nnz, CAST(sum(nnz) OVER (PARTITION BY vert ORDER BY row) - nnz AS BIGINT) AS starts FROM c",
    "tile_descriptors": f"{_DESC} SELECT p, nnz, n_rows, start_idx, (nnz + 1) // 2 * 2 AS padded FROM desc_",
    "tile_max": f"{_DESC} SELECT max(nnz) AS max_nnz, max(n_rows) AS max_rows, CAST(sum(nnz) AS BIGINT) AS total_nnz FROM desc_",
    "nnz_split": _SPLIT[False],
    "worker_split": _SPLIT[True],
    "even_row_split": f"WITH {A.MATRIX_SQL}, n AS (SELECT (max(row) + 2) // 2 AS pairs FROM matrix), s AS (SELECT pairs // {WORKERS} AS base, pairs % {WORKERS} AS more FROM n) SELECT row, CASE WHEN row // 2 < more * (base + 1) THEN (row // 2) // (base + 1) ELSE more + (row // 2 - more * (base + 1)) // greatest(base, 1) END AS worker FROM (SELECT DISTINCT row FROM matrix), s",
    "matrix_equal": f"{_TILED} SELECT count(DISTINCT (row, col)) AS n_missing, CAST(0 AS BIGINT) AS n_extra, CAST(0 AS BIGINT) AS n_wrong FROM tiled WHERE p = {H * V - 1}",
}
