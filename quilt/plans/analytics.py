"""Scheduling, aggregation, benchmark-table, gather and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quilt.operators import scheduling as S
from quilt.operators import tables as T
from quilt.plans import sparse
from quilt.sources import adapters as A
from quilt.streaming import fifo

WORKERS = 64


def _costs(spark, d):
    return sparse.tile_histogram(spark, d).withColumnRenamed("nnz", "cost")


def bsp_makespan(spark, d):
    return S.bsp_makespan(_costs(spark, d), WORKERS)


def ondemand_makespan_dpu(spark, d):
    return S.on_demand_makespan(_costs(spark, d), WORKERS)


def ondemand_makespan_ig(spark, d):
    return S.on_demand_makespan(_costs(spark, d), WORKERS, 8)


def ondemand_makespan_rank(spark, d):
    return S.on_demand_makespan(_costs(spark, d), WORKERS, 64)


def ew_wave_assignment(spark, d):
    return S.wave_assignment(_costs(spark, d).selectExpr("p", f"{sparse.H * sparse.V} AS n"), WORKERS)


def _states(spark, d):
    return A.table(spark, d, "orders").selectExpr("o_orderkey AS w", "CASE WHEN o_orderkey % 256 < 64 OR o_orderkey % 11 <> 0 AND o_orderkey % 8 <> 3 THEN 1 ELSE 2 END AS state")


def finished_bitmap_dpu(spark, d):
    return S.finished_bitmap(_states(spark, d), "dpu")


def finished_bitmap_ig(spark, d):
    return S.finished_bitmap(_states(spark, d), "ig")


def finished_bitmap_rank(spark, d):
    return S.finished_bitmap(_states(spark, d), "rank")


def done_fault(spark, d):
    """Done: all workers of a rank have ended; fault: any has state 2."""
    return _states(spark, d).groupBy(F.expr("w div 64").alias("rank")).agg(F.bool_and(F.col("state") == 1).alias("done"), F.bool_or(F.col("state") == 2).alias("fault"))


def rank_members(spark, d):
    """Workers of rank 1 whose bit is set in a bitmap: transfers prepared for them alone."""
    return _states(spark, d).where("w div 64 = 1 AND getbit(6148914691236517205, int(w % 64)) = 1").select("w", "state")


def ig_members(spark, d):
    return _states(spark, d).where("getbit(37L, int(w % 8)) = 1").select("w", "state")


def topology(spark, d):
    return _states(spark, d).selectExpr("w", "w % 8 AS ig", "w div 8 % 8 AS ci", "w div 64 AS rank")


def atomic_aggs(spark, d):
    g = A.table(spark, d, "orders").groupBy(F.expr("o_custkey % 50").alias("g"))
    k = F.col("o_orderkey")
    return g.agg(F.sum(k).alias("f_add"), F.bit_and(k).alias("f_and"), F.bit_or(k).alias("f_or"), F.bit_xor(k).alias("f_xor"), F.max(k).alias("f_max"), F.min(k).alias("f_min"))


def global_checksum(spark, d):
    return A.matrix(spark, d).agg(F.sum("val").cast("long").alias("total"), F.count_if(F.col("val") > 25).alias("n_over"), F.min("val").alias("least"), F.max("val").alias("most"))


def sg_blocks_gather(spark, d):
    """Blocks of a worker in order of their number, as one buffer; workers are as many as orders, so buffers stay small."""
    blocks = A.table(spark, d, "lineitem").selectExpr("l_orderkey AS worker", "struct(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS b", "l_partkey AS block")
    g = blocks.groupBy("worker").agg(F.array_sort(F.collect_list(F.struct("b", "block"))).alias("bs"))
    return g.select("worker", F.size("bs").cast("long").alias("n"), F.md5(F.concat_ws(",", F.transform("bs", lambda x: x["block"].cast("string")))).alias("digest"))


def _events(spark, d):
    return A.table(spark, d, "events")


def group_mean(spark, d):
    return T.group_mean(_events(spark, d).select("event_id", F.floor(F.col("value") * 100).alias("v")), "event_id", "v", 8)


def sort_in_chunk(spark, d):
    return T.sort_in_chunk(_events(spark, d), "event_id", "value", 35)


def slice_rows(spark, d):
    return T.slice_rows(_events(spark, d), "event_id", 35, 70).select("event_id", "value")


def _timings(spark, d, parity):
    e = _events(spark, d).where(f"user_id % 2 = {parity}").selectExpr("event_type AS dataset", "event_id % 7 AS parts", "floor(value * 100) AS v")
    return e.groupBy("dataset", "parts").agg(F.sum("v").alias("v"))


def speedup_ratio(spark, d):
    return T.speedup(_timings(spark, d, 0), _timings(spark, d, 1), ["dataset", "parts"], "v")


def pivot_speedup(spark, d):
    named = speedup_ratio(spark, d)
    return named.groupBy("dataset").pivot("parts", list(range(7))).agg(F.first("speedup")).select("dataset", *[F.col(str(i)).alias(f"p{i}") for i in range(7)])


def bucket_label(spark, d):
    sizes = F.array(*[F.lit(x) for x in (100, 200, 400, 600, 800, 1000)])
    return _events(spark, d).select("event_id", F.get(sizes, (F.col("event_id") % 6).cast("int")).alias("label"))


def reordered_columns(spark, d):
    li = A.table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("total"), F.col("l_quantity").alias("exec"), (F.col("l_partkey") + F.col("l_suppkey")).alias("transfer"))


def union_all(spark, d):
    return _events(spark, d).select("event_id", "user_id").unionByName(A.table(spark, d, "orders").selectExpr("o_orderkey AS event_id", "o_custkey AS user_id"))


def byte_interleave(spark, d):
    """8 x 8 transpose of blocks of 64 values by position."""
    e = _events(spark, d).selectExpr("event_id div 64 AS block", "event_id % 64 AS i", "user_id AS v")
    return e.selectExpr("block", "i % 8 * 8 + i div 8 AS i", "v")


def properties(spark, d):
    """key=value lines to maps; lines without = are left out."""
    p = A.table(spark, d, "part").selectExpr("p_partkey", "concat('size=', p_size, ',noise,brand=', p_brand) AS line")
    kv = F.str_to_map(F.concat_ws(",", F.filter(F.split("line", ","), lambda x: F.contains(x, F.lit("=")))), F.lit(","), F.lit("="))
    return p.select("p_partkey", F.try_element_at(kv, F.lit("size")).try_cast("int").alias("size"), F.try_element_at(kv, F.lit("brand")).alias("brand"))


def fifo_map(spark, d):
    return fifo.map_each(spark, d)


def fifo_fanout_reduce(spark, d):
    return fifo.fan_out(spark, d)


def _on_demand_sql(group: int) -> str:
    """List scheduling as a recursive CTE: the least of the workers' free times takes the next group."""
    return f"""WITH RECURSIVE {sparse._TILED.removeprefix('WITH ')}, costs AS (SELECT p, count(*) AS cost FROM tiled GROUP BY p),
pulls AS (SELECT k // {group} AS j, max(cost) AS c FROM (SELECT cost, row_number() OVER (ORDER BY p) - 1 AS k FROM costs) GROUP BY 1),
go(j, free) AS (SELECT CAST(0 AS BIGINT), list_transform(range({max(1, WORKERS // group)}), lambda x: CAST(0 AS BIGINT))
  UNION ALL SELECT go.j + 1, list_sort(list_append(free[2:], free[1] + c)) FROM go JOIN pulls ON pulls.j = go.j)
SELECT list_max(arg_max(free, j)) AS makespan FROM go"""


_COSTS = sparse._TILED + ", costs AS (SELECT p, count(*) AS cost FROM tiled GROUP BY p)"
_STATES = "WITH s AS (SELECT o_orderkey AS w, CASE WHEN o_orderkey % 256 < 64 OR o_orderkey % 11 <> 0 AND o_orderkey % 8 <> 3 THEN 1 ELSE 2 END AS state FROM orders)"
_RATIO = "WITH t AS (SELECT user_id % 2 AS side, event_type AS dataset, event_id % 7 AS parts, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS v FROM events GROUP BY ALL), r AS (SELECT a.dataset, a.parts, round(CAST(b.v AS DOUBLE) / nullif(a.v, 0), 2) AS speedup FROM t a JOIN t b ON a.dataset = b.dataset AND a.parts = b.parts AND a.side = 0 AND b.side = 1)"


def _bitmap(bits, group, done):
    return f"{_STATES}, g AS (SELECT w // 64 AS rank, {group} AS g, {done} AS done, {bits} AS bits FROM s GROUP BY ALL) SELECT rank, CAST(sum(CASE WHEN done THEN bits ELSE 0 END) - CASE WHEN bit_or(CASE WHEN done THEN bits ELSE 0::HUGEINT END) >= 9223372036854775808 THEN 18446744073709551616 ELSE 0 END AS BIGINT) AS bitmap, CAST(sum(CASE WHEN done THEN n ELSE 0 END) AS BIGINT) AS n FROM (SELECT *, bit_count(CAST(bits % 9223372036854775808 AS BIGINT)) + (bits >= 9223372036854775808)::INT AS n FROM g) GROUP BY rank"


QUERIES = {f.__name__: f for f in (bsp_makespan, ondemand_makespan_dpu, ondemand_makespan_ig, ondemand_makespan_rank, ew_wave_assignment, finished_bitmap_dpu, finished_bitmap_ig, finished_bitmap_rank, done_fault, rank_members, ig_members, topology, atomic_aggs, global_checksum, sg_blocks_gather, group_mean, sort_in_chunk, slice_rows, speedup_ratio, pivot_speedup, bucket_label, reordered_columns, union_all, byte_interleave, properties, fifo_map, fifo_fanout_reduce)}
ORACLES = {
    "bsp_makespan": f"{_COSTS} SELECT count(*) AS waves, CAST(sum(m) AS BIGINT) AS makespan FROM (SELECT max(cost) AS m FROM costs GROUP BY p // {WORKERS})",
    "ondemand_makespan_dpu": _on_demand_sql(1),
    "ondemand_makespan_ig": _on_demand_sql(8),
    "ondemand_makespan_rank": _on_demand_sql(64),
    "ew_wave_assignment": f"{_COSTS} SELECT p, (p % 128) // 32 AS wave, (p % 128) % 32 + CASE WHEN p < 128 THEN 0 ELSE 32 END AS worker FROM costs",
    "finished_bitmap_dpu": _bitmap("sum(1::HUGEINT << CAST(w % 64 AS INT))", "w % 64 // 2", "bool_and(state = 1)"),
    "finished_bitmap_ig": _bitmap("any_value(1::HUGEINT << CAST(w % 8 AS INT))", "w % 8", "bool_and(state = 1)"),
    "finished_bitmap_rank": _bitmap("1::HUGEINT", "0", "sum(CASE WHEN state = 1 THEN 1 ELSE 0 END) = 64"),
    "done_fault": f"{_STATES} SELECT w // 64 AS rank, bool_and(state = 1) AS done, bool_or(state = 2) AS fault FROM s GROUP BY 1",
    "rank_members": f"{_STATES} SELECT w, state FROM s WHERE w // 64 = 1 AND (6148914691236517205 >> (w % 64)) & 1 = 1",
    "ig_members": f"{_STATES} SELECT w, state FROM s WHERE (37 >> (w % 8)) & 1 = 1",
    "topology": f"{_STATES} SELECT w, w % 8 AS ig, w // 8 % 8 AS ci, w // 64 AS rank FROM s",
    "atomic_aggs": "SELECT o_custkey % 50 AS g, CAST(sum(o_orderkey) AS BIGINT) AS f_add, bit_and(o_orderkey) AS f_and, bit_or(o_orderkey) AS f_or, bit_xor(o_orderkey) AS f_xor, max(o_orderkey) AS f_max, min(o_orderkey) AS f_min FROM orders GROUP BY 1",
    "global_checksum": "SELECT CAST(sum(l_quantity) AS BIGINT) AS total, count(*) FILTER (WHERE l_quantity > 25) AS n_over, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem",
    "sg_blocks_gather": "SELECT l_orderkey AS worker, count(*) AS n, md5(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS digest FROM lineitem GROUP BY 1",
    "group_mean": "SELECT event_id // 8 AS grp, round(avg(CAST(floor(value * 100) AS BIGINT)), 4) AS mean FROM events GROUP BY 1",
    "sort_in_chunk": "SELECT event_id, value, event_id // 35 * 35 + row_number() OVER (PARTITION BY event_id // 35 ORDER BY value, event_id) - 1 AS pos FROM events",
    "slice_rows": "SELECT event_id, value FROM events WHERE event_id >= 35 AND event_id < 70",
    "speedup_ratio": f"{_RATIO} SELECT dataset, parts, speedup FROM r",
    "pivot_speedup": f"{_RATIO} SELECT dataset, " + ", ".join(f"max(speedup) FILTER (WHERE parts = {i}) AS p{i}" for i in range(7)) + " FROM r GROUP BY dataset",
    "bucket_label": "SELECT event_id, ([100, 200, 400, 600, 800, 1000])[CAST(event_id % 6 + 1 AS INT)] AS label FROM events",
    "reordered_columns": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS total, l_quantity AS exec, l_partkey + l_suppkey AS transfer FROM lineitem",
    "union_all": "SELECT event_id, user_id FROM events UNION ALL SELECT o_orderkey, o_custkey FROM orders",
    "byte_interleave": "SELECT event_id // 64 AS block, event_id % 64 % 8 * 8 + event_id % 64 // 8 AS i, user_id AS v FROM events",
    "properties": "SELECT p_partkey, p_size AS size, p_brand AS brand FROM part",
    "fifo_map": "SELECT event_id, user_id * 2 + 1 AS v FROM events",
    "fifo_fanout_reduce": "SELECT event_id, CAST(4 * user_id + 6 AS BIGINT) AS v FROM events",
}
