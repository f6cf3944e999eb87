"""Queues, transfers, worker sets, atomic updates and round trips through the binary and text files."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf

from quilt.operators import tiling as T
from quilt.operators import workers as W
from quilt.operators.store import cut, new_path
from quilt.plans import sparse
from quilt.session import Config
from quilt.sources import adapters as A
from quilt.sources import files
from quilt.streaming import ring

PTR_SIZE, QUEUES, SERVICE, RETRIES, WAIT = 2, 64, 3, 2, 2


def _links(spark, d):
    return A.table(spark, d, "part").selectExpr("p_partkey AS queue", "p_size % 13 AS ptr_size", "p_size % 5 * 4 AS elem_bytes")


def fifo_geometry(spark, d):
    return ring.geometry(_links(spark, d))


def fifo_links(spark, d):
    return ring.linked(_links(spark, d))


def _log(spark, d):
    ops = F.array(*[F.lit(x) for x in ("push", "push", "push", "pop", "pop", "peek", "reserve", "cede")])
    return A.table(spark, d, "events").select(F.expr(f"user_id % {QUEUES}").alias("queue"), F.col("event_id").alias("seq"), F.get(ops, (F.col("event_id") % 8).cast("int")).alias("op"))


def fifo_flags(spark, d):
    """Whether a queue is empty or full after each operation."""
    return ring.replay(_log(spark, d), PTR_SIZE).select("queue", "seq", "is_empty", "is_full")


def fifo_peek_pop(spark, d):
    return ring.replay(_log(spark, d), PTR_SIZE).where("op IN ('pop', 'peek')").select("queue", "seq", "op", "ok", "slot", "rd")


def fifo_push_reserve(spark, d):
    return ring.replay(_log(spark, d), PTR_SIZE).where("op IN ('push', 'reserve', 'cede')").select("queue", "seq", "op", "ok", "slot", "wr", "reserved")


def fifo_accessors(spark, d):
    """A queue's most elements, its elements, the slot of its first and the fullest queue of a group of 8."""
    got = ring.replay(_log(spark, d), PTR_SIZE).groupBy("queue").agg(F.max_by(F.struct("rd", "wr"), "seq").alias("last"), F.max(F.expr("wr - rd")).alias("most"))
    return got.selectExpr("queue", "last.wr - last.rd AS size", f"last.rd % {1 << PTR_SIZE} AS first_slot", "most")


def fifo_waits(spark, d):
    pushes = A.table(spark, d, "events").selectExpr("user_id AS queue", "event_id AS seq", "event_id div 60 AS at")
    return ring.waits(pushes, 1 << PTR_SIZE, SERVICE, RETRIES, WAIT)


def fifo_push_rounds(spark, d):
    return ring.push_rounds(_log(spark, d), QUEUES)


def resident_runs(spark, d):
    states = A.table(spark, d, "events").selectExpr("user_id AS worker", "event_id AS seq", "CASE WHEN event_id % 61 = 0 THEN 0 WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS state")
    return ring.resident_runs(states)


def checkpoint_restore(spark, d):
    """A snapshot of three tables, of which two come back."""
    o = A.table(spark, d, "orders")
    parts = {s: o.where(F.col("o_orderstatus") == s).select("o_orderkey", "o_custkey") for s in ("O", "F", "P")}
    back = W.restored(spark, W.snapshot(parts, spark), "O", "F")
    return back["O"].withColumn("part", F.lit("O")).unionByName(back["F"].withColumn("part", F.lit("F")))


def _rows(spark, d):
    return A.table(spark, d, "orders").selectExpr("o_custkey % 130 AS worker", "o_orderkey AS seq", "o_custkey AS value")


def xfer_scatter(spark, d):
    return W.scattered(_rows(spark, d))


def xfer_gather(spark, d):
    """Scatter, then gather without the padding."""
    rows = _rows(spark, d)
    return W.gathered(W.scattered(rows), rows.groupBy("worker").agg(F.count("*").alias("n")))


def xfer_copy(spark, d):
    """One worker's buffer overwritten from its third value on."""
    source = A.table(spark, d, "nation").selectExpr("CAST(n_nationkey AS LONG) AS slot", "CAST(-n_nationkey - 1 AS LONG) AS value")
    return W.copied(W.scattered(_rows(spark, d)), source, 7, 3)


def xfer_broadcast(spark, d):
    return W.broadcast_to(A.table(spark, d, "part").selectExpr("p_partkey AS slot", "CAST(p_size AS LONG) AS value"), 16)


def _set(spark, d):
    return A.table(spark, d, "orders").selectExpr("o_orderkey AS w", "o_custkey % 9 <> 0 AS enabled", "CAST(o_custkey % 3 AS INT) AS state")


def set_cardinality(spark, d):
    return W.cardinality(_set(spark, d).where("w % 64 < 3 OR w % 1000 > 500"))


def set_state_dpu(spark, d):
    return W.with_state(_set(spark, d), "dpu", [3, 5, 700], 7)


def set_state_ig(spark, d):
    return W.with_state(_set(spark, d), "ig", [2, 11, 87], 7)


def set_state_rank(spark, d):
    return W.with_state(_set(spark, d), "rank", [0, 9, 12], 7)


def rank_callback(spark, d):
    def fn(own: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"rank": [own["rank"].iloc[0]], "n": [len(own)], "total": [int(own.loc[own["enabled"], "state"].sum())]})

    return W.called(_set(spark, d), fn, "rank long, n long, total long", asynchronous=True, nonblocking=True)


def _running_sum(own: pd.DataFrame) -> pd.DataFrame:
    return own.assign(value=own["value"].cumsum())


def workerset_run(spark, d):
    """Scatter, a kernel on every worker's buffer, gather."""
    with W.WorkerSet(spark, 130) as workers:
        workers.copy("x", _rows(spark, d))
        workers.run(_running_sum, "x", "y")
        return workers.gather("y")


def workerset_call(spark, d):
    workers = W.WorkerSet(spark, A.table(spark, d, "orders").count())
    return workers.call(lambda own: pd.DataFrame({"rank": [own["rank"].iloc[0]], "last": [own["w"].max()]}), "rank long, last long")


def workerset_checkpoint(spark, d):
    workers = W.WorkerSet(spark, 16)
    workers.copy("x", A.table(spark, d, "nation").selectExpr("CAST(n_nationkey AS LONG) AS slot", "CAST(n_regionkey AS LONG) AS value"))
    path = workers.checkpoint("x")
    workers.buffers.clear()
    workers.restore(path, "x")
    return workers.gather("x")


def kernel_udf(spark, d):
    """y of each vertical tile by a kernel on its records, then added up."""
    m = A.matrix(spark, d)
    tiles = T.tiled(m, *sparse.grid(m), sparse.V)

    def kernel(own: pd.DataFrame) -> pd.DataFrame:
        rows, at = np.unique(own["row"].to_numpy(), return_inverse=True)
        return pd.DataFrame({"row": rows, "y": np.bincount(at, weights=own["val"].to_numpy() * (own["col"].to_numpy() % 4 + 1))})

    return tiles.select("p", "row", "col", "val").groupBy("p").applyInPandas(kernel, "row long, y double").groupBy("row").agg(F.sum("y").alias("y"))


def typed_views(spark, d):
    """The bytes of a long, little-endian, as numbers of other widths."""

    def views(batches):
        for batch in batches:
            raw = np.ascontiguousarray((batch["o_orderkey"].to_numpy() * 1_000_000_007_777).astype("<i8"))
            ints = {"i8": raw.view("<i1")[::8], "u8": raw.view("<u1")[::8], "i16": raw.view("<i2")[::4], "u16": raw.view("<u2")[::4], "i32": raw.view("<i4")[::2], "u32": raw.view("<u4")[::2]}
            yield pd.DataFrame({"id": batch["o_orderkey"], **{k: v.astype("int64") for k, v in ints.items()}})

    return A.table(spark, d, "orders").select("o_orderkey").mapInPandas(views, "id long, i8 long, u8 long, i16 long, u16 long, i32 long, u32 long")


def user_reduce(spark, d):
    """A reduction of the user's: bits of one group of values put together."""

    @pandas_udf("long")
    def merged(v: pd.Series) -> int:
        return int(np.bitwise_xor.reduce(v.to_numpy())) * 2 + 1

    return A.table(spark, d, "events").groupBy("event_type").agg(merged("event_id").alias("v"))


def user_blocks(spark, d):
    """A generator of the user's that lists a row's blocks."""

    @udtf(returnType="block: long, size: long")
    class Blocks:
        def eval(self, n: int):
            at = 0
            while n > 0:
                yield at, min(n, 16)
                at, n = at + 1, n - 16

    spark.udtf.register("blocks_of", Blocks)
    A.table(spark, d, "part").select("p_partkey", "p_size").createOrReplaceTempView("quilt_parts")
    return spark.sql("SELECT p_partkey, block, size FROM quilt_parts, LATERAL blocks_of(CAST(p_size AS BIGINT))")


def atomic_nand(spark, d):
    return W.nand_folded(A.table(spark, d, "orders").selectExpr("o_custkey % 50 AS g", "o_orderkey AS seq", "o_custkey * 2654435761 % 4294967296 AS v"))


def atomic_more(spark, d):
    """Subtraction from 0, unsigned extremes and test-and-set, whose first caller finds 0."""
    rows = A.table(spark, d, "orders").selectExpr("o_custkey % 50 AS g", "o_orderkey AS seq", "o_orderkey - 7000 AS v")
    flipped = F.col("v").bitwiseXOR(F.lit(-(1 << 63)))
    return rows.groupBy("g").agg((-F.sum("v")).alias("f_sub"), F.min_by("v", flipped).alias("f_umin"), F.max_by("v", flipped).alias("f_umax"), F.min("seq").alias("tas_winner"))


def atomic_cas(spark, d):
    return W.compared_and_swapped(A.table(spark, d, "orders").selectExpr("o_custkey % 50 AS g", "o_orderkey AS seq", "o_orderkey % 3 AS expected", "o_orderkey % 5 % 3 AS new"))


def byte_updates(spark, d):
    return W.byte_updates(A.table(spark, d, "orders").selectExpr("o_custkey % 997 AS address", "o_orderkey AS seq", "o_custkey % 256 AS value"))


def phase_totals(spark, d):
    marks = A.table(spark, d, "events").selectExpr("user_id AS worker", "event_type AS phase", "event_id AS seq", "event_id * event_id AS at")
    return W.phase_totals(marks)


def horizontal_parts(spark, d):
    """Partitions along rows when so many are wanted in all and so many along columns."""
    return A.table(spark, d, "part").selectExpr("p_partkey", "p_partkey div (p_size % 7 + 1) AS horizontal")


def tile_fits(spark, d):
    """Tiles with the bytes that they take and whether a worker holds them; the tiling itself is made either way."""
    m = A.matrix(spark, d)
    h, w = sparse.grid(m)
    n = T.tiled(m, h, w, sparse.V).groupBy("p").agg(F.count("*").alias("nnz"))
    return n.select("p", (F.col("nnz") * 8 + 4 * (h + 2)).alias("bytes"), (F.col("nnz") * 8 + 4 * (h + 2) <= 6000).alias("fits"))


def run_parameters(spark, d):
    """Rows dealt by the parameters of a run, as given on a command line over the defaults."""
    run = Config.parsed(["-s", "50", "-d", "32"])
    return A.table(spark, d, "part").selectExpr("p_partkey", f"p_partkey div {run.subgraph_width} AS sg", f"p_partkey div {run.subgraph_width} % {run.workers} AS worker", f"{run.iterations} AS iterations")


def matrix_compare(spark, d):
    """Both sides' records that the other lacks, and common ones whose values differ by more than 1e-6."""
    m = A.matrix(spark, d).groupBy("row", "col").agg(F.sum("val").alias("val"))
    other = m.where("row % 97 <> 0").selectExpr("row", "col", "CASE WHEN row % 10 = 1 THEN val + 1e-9 WHEN row % 10 = 2 THEN val + 1 ELSE val END AS val")
    other = other.unionByName(m.where("row % 89 = 0").selectExpr("row", "col + 1000000 AS col", "val"))
    return T.compared(m, other)


def mtx_text(spark, d):
    """Orders by suppliers as a MatrixMarket text, rows first in its header, and back."""
    path = new_path(spark, "mtx")
    files.write_mtx(A.table(spark, d, "lineitem").selectExpr("l_orderkey AS row", "l_suppkey AS col").distinct(), path, rows_first=True)
    rows, cols, n = files.mtx_extent(spark, path, rows_first=True, pad_to=2)
    return files.read_mtx(spark, path).withColumns({"n_rows": F.lit(rows).cast("long"), "n_cols": F.lit(cols).cast("long"), "nnz": F.lit(n).cast("long")})


def dcsr_file(spark, d):
    """Tiles written as one binary file and read back."""
    m = A.matrix(spark, d)
    rows, cols = T.extent(m)
    h, w = sparse.grid(m)
    path = new_path(spark, "dcsr")
    files.write_dcsr(T.tiled(m, h, w, sparse.V), path, rows, cols, sparse.H, sparse.V, h, w)
    return files.read_dcsr(spark, path)


def rbdcsr_file(spark, d):
    m = A.matrix(spark, d)
    rows, cols = T.extent(m)
    width, path = -(-cols // 2), new_path(spark, "rbdcsr")
    files.write_rbdcsr(T.vertical(m, width), path, rows, cols, 2, width)
    return files.read_rbdcsr(spark, path)


def graph_file(spark, d):
    """Edges between nodes 0 to n - 1 as a binary graph file and back."""
    edges = A.table(spark, d, "orders").selectExpr("o_orderkey AS eid", "o_orderkey % 500 AS src", "o_custkey % 500 AS dst")
    nodes = spark.range(500).selectExpr("id AS n", "id div 50 AS sg", "id % 3 = 0 AS is_icn")
    path = new_path(spark, "graph")
    files.write_graph(nodes, cut(edges, "edges"), path)
    n, e, _ = files.read_graph(spark, path, 10)
    return e.join(n, e["src"] == n["n"]).groupBy("src", "dst", "sg", "is_icn").agg(F.count("*").alias("k"))


def timing_file(spark, d):
    """Timings appended twice to a headerless file and read back, means by workers."""
    path = new_path(spark, "timings")
    rows = A.table(spark, d, "part").selectExpr("p_size AS nr_dpus", *[f"CAST(p_partkey % {k} AS DOUBLE) AS {c}" for k, c in enumerate(("merge", "send", "retrieve", "exec", "exec_wall", "total"), 3)])
    for half in (0, 1):
        files.append_timings(rows.where(f"CAST(total AS INT) % 2 = {half}"), path)
    return files.read_timings(spark, path).groupBy("nr_dpus").agg(F.count("*").alias("n"), F.sum("exec").cast("long").alias("exec"), F.sum("total").cast("long").alias("total"))


def figure_file(spark, d):
    path = new_path(spark, "figures")
    files.write_figures(A.table(spark, d, "nation").selectExpr("n_nationkey AS parts", "n_nationkey / 8D + 0.00001D AS speedup"), path)
    return files.read_figures(spark, path, "parts int, speedup double")


_TILED = sparse._TILED
_LOG = f"""log AS (SELECT user_id % {QUEUES} AS queue, event_id AS seq, (['push', 'push', 'push', 'pop', 'pop', 'peek', 'reserve', 'cede'])[CAST(event_id % 8 + 1 AS INT)] AS op,
  row_number() OVER (PARTITION BY user_id % {QUEUES} ORDER BY event_id) AS k FROM events)"""
_REPLAY = f"""WITH RECURSIVE {_LOG}, r(queue, k, seq, op, ok, slot, rd, wr, held) AS (
  SELECT DISTINCT queue, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), '', false, CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM log
  UNION ALL SELECT x.queue, x.k, x.seq, x.op, x.ok, CASE WHEN x.ok AND op = 'push' THEN wr % 4 WHEN x.ok AND op IN ('pop', 'peek') THEN rd % 4 END,
    rd + (x.ok AND op = 'pop')::INT, wr + (x.ok AND op = 'push')::INT, held + (x.ok AND op = 'reserve')::INT - (x.ok AND op = 'cede')::INT
  FROM (SELECT l.queue, l.k, l.seq, l.op, r.rd, r.wr, r.held, CASE WHEN l.op IN ('push', 'reserve') THEN r.wr + r.held - r.rd < 4 WHEN l.op = 'cede' THEN r.held > 0 ELSE r.rd < r.wr END AS ok
    FROM r JOIN log l ON l.queue = r.queue AND l.k = r.k + 1) x),
a AS (SELECT * FROM r WHERE k > 0)"""
_SCAT = "r AS (SELECT o_custkey % 130 AS worker, o_custkey AS value, row_number() OVER (PARTITION BY o_custkey % 130 ORDER BY o_orderkey) - 1 AS slot FROM orders), len AS (SELECT (max(slot) + 2) // 2 * 2 AS n FROM r), cells AS (SELECT worker, slot FROM (SELECT DISTINCT worker FROM r), len, range(0, (SELECT n FROM len)) s(slot)), buf AS (SELECT cells.worker, cells.slot, coalesce(value, 0) AS value FROM cells LEFT JOIN r ON r.worker = cells.worker AND r.slot = cells.slot)"
_SET = "s AS (SELECT o_orderkey AS w, o_custkey % 9 <> 0 AS enabled, CAST(o_custkey % 3 AS INT) AS state FROM orders)"


def _set_sql(key: str, ids: str) -> str:
    return f"WITH {_SET} SELECT w, CASE WHEN {key} IN ({ids}) THEN 7 ELSE state END AS state FROM s"


def _view(k: int, bits: int) -> str:
    value = f"(CAST(o_orderkey AS HUGEINT) * 1000000007777) % {1 << bits}"
    return f"CAST({value} - CASE WHEN {value} >= {1 << (bits - 1)} THEN {k * (1 << bits)} ELSE 0 END AS BIGINT)"


QUERIES = {f.__name__: f for f in (
    fifo_geometry, fifo_links, fifo_flags, fifo_peek_pop, fifo_push_reserve, fifo_accessors, fifo_waits, fifo_push_rounds, resident_runs, checkpoint_restore,
    xfer_scatter, xfer_gather, xfer_copy, xfer_broadcast, set_cardinality, set_state_dpu, set_state_ig, set_state_rank, rank_callback,
    workerset_run, workerset_call, workerset_checkpoint, kernel_udf, typed_views, user_reduce, user_blocks,
    atomic_nand, atomic_more, atomic_cas, byte_updates, phase_totals, horizontal_parts, tile_fits, run_parameters, matrix_compare,
    mtx_text, dcsr_file, rbdcsr_file, graph_file, timing_file, figure_file,
)}
_GEO = "g AS (SELECT p_partkey AS queue, p_size % 13 AS ptr_size, p_size % 5 * 4 AS elem_bytes, CAST(1 << (p_size % 13) AS BIGINT) AS slots, CAST((1 << (p_size % 13)) * (p_size % 5 * 4) AS BIGINT) AS buffer_bytes, p_size % 13 <= 10 AND p_size % 5 IN (2, 4) AS valid FROM part)"
ORACLES = {
    "fifo_geometry": f"WITH {_GEO} SELECT * FROM g",
    "fifo_links": f"WITH {_GEO} SELECT queue, direction, slots, buffer_bytes, CAST(1000 AS BIGINT) AS max_retries, CAST(10 AS BIGINT) AS wait_us FROM g, (VALUES ('input'), ('output')) v(direction) WHERE valid",
    "fifo_flags": f"{_REPLAY} SELECT queue, seq, rd = wr AS is_empty, wr + held - rd = 4 AS is_full FROM a",
    "fifo_peek_pop": f"{_REPLAY} SELECT queue, seq, op, ok, slot, rd FROM a WHERE op IN ('pop', 'peek')",
    "fifo_push_reserve": f"{_REPLAY} SELECT queue, seq, op, ok, slot, wr, held AS reserved FROM a WHERE op IN ('push', 'reserve', 'cede')",
    "fifo_accessors": f"{_REPLAY} SELECT queue, arg_max(wr - rd, seq) AS size, arg_max(rd % 4, seq) AS first_slot, max(wr - rd) AS most FROM a GROUP BY queue",
    "fifo_waits": f"""WITH RECURSIVE e AS (SELECT user_id AS queue, event_id AS seq, event_id // 60 AS came, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
r(queue, k, seq, came, pushed, ends) AS (SELECT DISTINCT queue, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM e
  UNION ALL SELECT queue, k, seq, came, pushed, list_append(ends, greatest(pushed, coalesce(ends[-1], 0)) + {SERVICE})
  FROM (SELECT e.queue, e.k, e.seq, e.came, r.ends, greatest(e.came, coalesce(r.ends[-{1 << PTR_SIZE}], 0)) AS pushed FROM r JOIN e ON e.queue = r.queue AND e.k = r.k + 1))
SELECT queue, seq, pushed, (pushed - came + {WAIT - 1}) // {WAIT} AS retries, (pushed - came + {WAIT - 1}) // {WAIT} > {RETRIES} AS failed FROM r WHERE k > 0""",
    "fifo_push_rounds": f"WITH {_LOG} SELECT k - 1 AS round, count(*) AS n, count(*) = {QUEUES} AS fast FROM log GROUP BY k",
    "resident_runs": "WITH e AS (SELECT user_id AS worker, event_id AS seq, CASE WHEN event_id % 61 = 0 THEN 0 WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS state FROM events), z AS (SELECT worker, min(seq) AS stop FROM e WHERE state = 0 GROUP BY worker) SELECT e.worker, count(*) FILTER (WHERE state = 2 AND (stop IS NULL OR seq < stop)) AS runs, any_value(stop) IS NOT NULL AS exited FROM e LEFT JOIN z ON z.worker = e.worker GROUP BY e.worker",
    "checkpoint_restore": "SELECT o_orderkey, o_custkey, o_orderstatus AS part FROM orders WHERE o_orderstatus IN ('O', 'F')",
    "xfer_scatter": f"WITH {_SCAT} SELECT * FROM buf",
    "xfer_gather": "SELECT row_number() OVER (ORDER BY o_custkey % 130, o_orderkey) - 1 AS idx, o_custkey AS value FROM orders",
    "xfer_copy": f"WITH {_SCAT} SELECT worker, slot, CAST(CASE WHEN worker = 7 AND slot BETWEEN 3 AND 27 THEN -(slot - 3) - 1 ELSE value END AS BIGINT) AS value FROM buf",
    "xfer_broadcast": "SELECT w.worker, p_partkey AS slot, CAST(p_size AS BIGINT) AS value FROM part, range(0, 16) w(worker)",
    "set_cardinality": f"WITH {_SET} SELECT count(DISTINCT w // 64) AS nr_ranks, count(DISTINCT w) AS nr_workers FROM s WHERE enabled AND (w % 64 < 3 OR w % 1000 > 500)",
    "set_state_dpu": _set_sql("w", "3, 5, 700"),
    "set_state_ig": _set_sql("w // 64 * 8 + w % 8", "2, 11, 87"),
    "set_state_rank": _set_sql("w // 64", "0, 9, 12"),
    "rank_callback": f"WITH {_SET} SELECT w // 64 AS rank, count(*) AS n, CAST(coalesce(sum(state) FILTER (WHERE enabled), 0) AS BIGINT) AS total FROM s GROUP BY 1",
    "workerset_run": f"WITH {_SCAT} SELECT worker, slot, CAST(sum(value) OVER (PARTITION BY worker ORDER BY slot) AS BIGINT) AS value FROM buf",
    "workerset_call": "SELECT w // 64 AS rank, max(w) AS last FROM range(0, (SELECT count(*) FROM orders)) r(w) GROUP BY 1",
    "workerset_checkpoint": "SELECT w.worker, CAST(n_nationkey AS BIGINT) AS slot, CAST(n_regionkey AS BIGINT) AS value FROM nation, range(0, 16) w(worker)",
    "kernel_udf": f"WITH {A.MATRIX_SQL} {sparse._Y}",
    "typed_views": f"SELECT o_orderkey AS id, {_view(1, 8)} AS i8, {_view(0, 8)} AS u8, {_view(1, 16)} AS i16, {_view(0, 16)} AS u16, {_view(1, 32)} AS i32, {_view(0, 32)} AS u32 FROM orders",
    "user_reduce": "SELECT event_type, bit_xor(event_id) * 2 + 1 AS v FROM events GROUP BY 1",
    "user_blocks": "SELECT p_partkey, b.block, CAST(least(p_size - 16 * b.block, 16) AS BIGINT) AS size FROM part, range(0, 1000) b(block) WHERE 16 * b.block < p_size",
    "atomic_nand": "SELECT o_custkey % 50 AS g, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list(o_custkey * 2654435761 % 4294967296 ORDER BY o_orderkey)), lambda x, v: CAST(4294967295 - (x & v) AS BIGINT)) AS f_nand FROM orders GROUP BY 1",
    "atomic_more": "SELECT o_custkey % 50 AS g, CAST(-sum(o_orderkey - 7000) AS BIGINT) AS f_sub, arg_min(o_orderkey - 7000, CASE WHEN o_orderkey < 7000 THEN CAST(o_orderkey - 7000 AS HUGEINT) + 18446744073709551616 ELSE o_orderkey - 7000 END) AS f_umin, arg_max(o_orderkey - 7000, CASE WHEN o_orderkey < 7000 THEN CAST(o_orderkey - 7000 AS HUGEINT) + 18446744073709551616 ELSE o_orderkey - 7000 END) AS f_umax, min(o_orderkey) AS tas_winner FROM orders GROUP BY 1",
    "atomic_cas": """WITH RECURSIVE o AS (SELECT o_custkey % 50 AS g, o_orderkey AS seq, o_orderkey % 3 AS expected, o_orderkey % 5 % 3 AS new, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS k FROM orders),
r(g, k, seq, swapped, held) AS (SELECT DISTINCT g, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), false, CAST(0 AS BIGINT) FROM o
  UNION ALL SELECT o.g, o.k, o.seq, r.held = o.expected, CASE WHEN r.held = o.expected THEN o.new ELSE r.held END FROM r JOIN o ON o.g = r.g AND o.k = r.k + 1)
SELECT g, seq, swapped, held FROM r WHERE k > 0""",
    "byte_updates": "SELECT o_custkey % 997 AS address, arg_max(o_custkey % 256, o_orderkey) AS value FROM orders GROUP BY 1",
    "phase_totals": "WITH e AS (SELECT user_id AS worker, event_type AS phase, event_id * event_id AS at, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i FROM events) SELECT b.worker, b.phase, count(*) AS n, CAST(sum(b.at - a.at) AS BIGINT) AS total FROM e a JOIN e b ON a.worker = b.worker AND a.phase = b.phase AND b.i = a.i + 1 AND b.i % 2 = 0 GROUP BY ALL",
    "horizontal_parts": "SELECT p_partkey, p_partkey // (p_size % 7 + 1) AS horizontal FROM part",
    "tile_fits": f"{_TILED}, hh AS (SELECT h FROM dim) SELECT p, CAST(count(*) * 8 + 4 * (any_value(h) + 2) AS BIGINT) AS bytes, count(*) * 8 + 4 * (any_value(h) + 2) <= 6000 AS fits FROM tiled, hh GROUP BY p",
    "run_parameters": "SELECT p_partkey, p_partkey // 50 AS sg, p_partkey // 50 % 32 AS worker, 50 AS iterations FROM part",
    "matrix_compare": f"""WITH {A.MATRIX_SQL}, m AS (SELECT row, col, sum(val) AS val FROM matrix GROUP BY ALL)
SELECT count(*) FILTER (WHERE row % 97 = 0) AS n_missing, count(*) FILTER (WHERE row % 89 = 0) AS n_extra, count(*) FILTER (WHERE row % 97 <> 0 AND row % 10 = 2) AS n_wrong FROM m""",
    "mtx_text": "WITH m AS (SELECT DISTINCT l_orderkey AS row, l_suppkey AS col FROM lineitem), n AS (SELECT (max(row) + 2) // 2 * 2 AS n_rows, (max(col) + 2) // 2 * 2 AS n_cols, count(*) AS nnz FROM m), i AS (SELECT row, col, row_number() OVER (ORDER BY row, col) - 1 AS idx FROM m) SELECT idx, row, col, CAST(idx % 4 + 1 AS DOUBLE) AS val, n_rows, n_cols, nnz FROM i, n",
    "dcsr_file": f"{_TILED} SELECT p, local_row, col % w AS local_col, val FROM tiled, (SELECT w FROM dim)",
    "rbdcsr_file": f"{sparse._VERT} SELECT vert, row, col % w2 AS local_col, val FROM vert, (SELECT w2 FROM dim)",
    "graph_file": "SELECT o_orderkey % 500 AS src, o_custkey % 500 AS dst, o_orderkey % 500 // 50 AS sg, o_orderkey % 500 % 3 = 0 AS is_icn, count(*) AS k FROM orders GROUP BY ALL",
    "timing_file": "SELECT p_size AS nr_dpus, count(*) AS n, CAST(sum(p_partkey % 6) AS BIGINT) AS exec, CAST(sum(p_partkey % 8) AS BIGINT) AS total FROM part GROUP BY 1",
    "figure_file": "SELECT n_nationkey AS parts, CAST(round(n_nationkey / 8.0 + 0.00001, 4) AS DOUBLE) AS speedup FROM nation",
}
