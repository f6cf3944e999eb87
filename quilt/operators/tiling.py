"""Re-tiling and load-balanced partitioning of sparse matrices (row, col, val)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quilt.operators.store import cut

#: Row ids whose counts one task sums up.
CHUNK = 1 << 16


def extent(m: DataFrame) -> tuple[int, int]:
    """Number of rows and columns, ids counted from 0; an empty matrix has none."""
    r = m.agg(F.max("row"), F.max("col")).first()
    return (r[0] or -1) + 1 if r[0] is not None else 0, (r[1] or -1) + 1 if r[1] is not None else 0


def tiled(m: DataFrame, height: int, width: int, n_vert: int) -> DataFrame:
    """Equal tiles: p = (row div height) * n_vert + col div width, with tile-local ids."""
    return m.selectExpr("*", f"(row div {height}) * {n_vert} + col div {width} AS p", f"row % {height} AS local_row", f"col % {width} AS local_col")


def vertical(m: DataFrame, width: int) -> DataFrame:
    """Vertical tiles of equal width; rows stay global."""
    return m.selectExpr("*", f"col div {width} AS vert", f"col % {width} AS local_col")


def running(counts: DataFrame, tile: str, row: str, value: str = "nnz") -> DataFrame:
    """counts with ``ends``, the inclusive running sum of value along row inside each tile.

    Summed in runs of CHUNK row ids and over the runs' totals, so a tile of any height is spread over tasks.
    """
    placed = counts.withColumn("__chunk", F.expr(f"`{row}` div {CHUNK}"))
    totals = placed.groupBy(tile, "__chunk").agg(F.sum(value).alias("__total"))
    before = Window.partitionBy(tile).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(tile).alias("__tile"), F.col("__chunk").alias("__at"), F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__base"))
    inside = F.sum(value).over(Window.partitionBy(tile, "__chunk").orderBy(row).rowsBetween(Window.unboundedPreceding, 0))
    joined = placed.withColumn("__inside", inside).join(totals, (F.col(tile) == F.col("__tile")) & (F.col("__chunk") == F.col("__at")))
    return joined.select(*counts.columns, (F.col("__base") + F.col("__inside")).alias("ends"))


def row_pointers(m: DataFrame, tile: str, row: str) -> DataFrame:
    """Per tile and row that holds anything: nnz and its exclusive and inclusive prefix sums."""
    counts = m.groupBy(tile, row).agg(F.count("*").alias("nnz"))
    return running(counts, tile, row).withColumn("starts", F.col("ends") - F.col("nnz"))


def nnz_splits(counts: DataFrame, parts: int, granularity: int = 1) -> DataFrame:
    """(tile, block, row_lo, row_hi, nnz): rows of a tile cut greedily where the running count reaches nnz div parts.

    counts: (tile, row, nnz). The sum starts again at 0 after a cut; cuts
    stand only behind rows whose next id is a multiple of granularity; rows
    after the last cut go to the last block, and blocks beyond it are absent.
    Each cut is one aggregation over the running sums, which are written once;
    the state carried along is a row a tile.
    """
    ends = cut(running(counts, "tile", "row"), "row-sums")
    state = ends.groupBy("tile").agg(F.max("ends").alias("total")).select("tile", F.expr(f"total div {parts}").alias("limit"), F.expr("CAST(0 AS BIGINT)").alias("upto"), F.expr("CAST(array() AS ARRAY<BIGINT>)").alias("cuts"))
    state = cut(state, "cuts")
    allowed = ends.where((F.col("row") + 1) % granularity == 0).select(F.col("tile").alias("t"), "row", "ends")
    for _ in range(parts - 1):
        found = allowed.join(state.select("tile", "limit", "upto", "cuts"), F.col("t") == F.col("tile")).where("ends - upto >= limit AND row > coalesce(try_element_at(cuts, -1), -1)")
        nearest = found.groupBy(F.col("tile").alias("t")).agg(F.min(F.struct("row", "ends")).alias("cut"))
        after = state.join(nearest, F.col("tile") == F.col("t"), "left")
        # Written, so its size is known: it's broadcast while it is small, and shuffled beyond that.
        state = cut(after.select("tile", "limit", F.coalesce("cut.ends", "upto").alias("upto"), F.when(F.col("cut").isNull(), F.col("cuts")).otherwise(F.array_append("cuts", F.col("cut.row"))).alias("cuts")), "cuts")
    state = state.select("tile", "cuts")
    block = F.size(F.filter("cuts", lambda c: c < F.col("row")))
    return counts.join(state, "tile").groupBy("tile", block.alias("block")).agg(F.min("row").alias("row_lo"), F.max("row").alias("row_hi"), F.sum("nnz").alias("nnz"))


def even_split(rows: DataFrame, n_rows: int, workers: int) -> DataFrame:
    """Rows dealt to workers in even-sized runs of contiguous pairs, the first workers taking what remains."""
    pairs = (n_rows + 1) // 2
    base, more = divmod(pairs, workers)
    big = more * (base + 1)
    pair = "(row div 2)"
    return rows.selectExpr("row", f"CASE WHEN {pair} < {big} THEN {pair} div {base + 1} ELSE {more} + ({pair} - {big}) div {max(base, 1)} END AS worker")


def spmv(m: DataFrame, x: DataFrame, tile: str | None = None) -> DataFrame:
    """y(row): products summed per tile first where a tile column is named, then per row."""
    products = m.join(x, "col").withColumn("v", F.col("val") * F.col("x"))
    if tile:
        products = products.groupBy(tile, "row").agg(F.sum("v").alias("v"))
    return products.groupBy("row").agg(F.sum("v").alias("y"))


def dense(y: DataFrame, n_rows: int) -> DataFrame:
    """All rows, 0 where the matrix holds nothing."""
    ids = y.sparkSession.range(n_rows).withColumnRenamed("id", "row")
    return ids.join(y, "row", "left").select("row", F.coalesce("y", F.lit(0.0)).alias("y"))


def differences(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """n_rows, n_wrong, and both checksums of y over all rows of either side."""
    both = a.select("row", F.col("y").alias("ya")).join(b.select("row", F.col("y").alias("yb")), "row", "full")
    wrong = F.coalesce(F.abs(F.col("ya") - F.col("yb")) > tolerance, F.lit(True))
    return both.agg(F.count("*").alias("n_rows"), F.count_if(wrong).alias("n_wrong"), F.sum("ya").alias("sum_a"), F.sum("yb").alias("sum_b"))


def compared(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """n_missing, n_extra, n_wrong: records (row, col, val) that b lacks, that a lacks, and values further apart than tolerance."""
    left, right = a.select("row", "col", F.col("val").alias("va")), b.select("row", "col", F.col("val").alias("vb"))
    both = left.join(right, ["row", "col"], "full")
    return both.agg(F.count_if(F.col("vb").isNull()).alias("n_missing"), F.count_if(F.col("va").isNull()).alias("n_extra"), F.count_if(F.abs(F.col("va") - F.col("vb")) > tolerance).alias("n_wrong"))
