"""Sets of workers: buffers scattered to them, gathered, broadcast and called on; states, atomic updates, snapshots.

A buffer is a table (worker, slot, value). Workers are numbered from 0; 64 of
them make a rank and those with equal number modulo 8 inside one a group.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quilt.operators.store import new_path

RANK, GROUPS = 64, 8
#: Values that a transfer's length is a multiple of.
ALIGN = 2


def scattered(rows: DataFrame, align: int = ALIGN) -> DataFrame:
    """(worker, slot, value) of rows (worker, seq, value): in order of seq, padded by 0 to the longest worker's aligned length."""
    placed = rows.withColumn("slot", (F.row_number().over(Window.partitionBy("worker").orderBy("seq")) - 1).cast("long"))
    longest = (placed.agg(F.max("slot")).first()[0] or 0) + 1
    length = -(-longest // align) * align
    held = placed.groupBy("worker").agg(F.count("*").alias("n"))
    padding = held.where(F.col("n") < length).select("worker", F.explode(F.sequence(F.col("n"), F.lit(length - 1))).alias("slot"), F.lit(0).cast("long").alias("value"))
    return placed.select("worker", "slot", F.col("value").cast("long").alias("value")).unionByName(padding)


def gathered(buffers: DataFrame, sizes: DataFrame) -> DataFrame:
    """(idx, value): buffers without their padding, worker after worker; sizes: (worker, n)."""
    before = F.coalesce(F.sum("n").over(Window.orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a worker
    starts = sizes.withColumn("start", before).select(F.col("worker").alias("w"), "n", "start")
    return buffers.join(starts, F.col("worker") == F.col("w")).where("slot < n").select((F.col("start") + F.col("slot")).alias("idx"), "value")


def copied(buffers: DataFrame, source: DataFrame, worker: int, offset: int) -> DataFrame:
    """buffers after source (slot, value) has been written to one worker's buffer from offset on; only slots that are there change."""
    given = source.select(F.lit(worker).cast("long").alias("w"), (F.col("slot") + offset).alias("s"), F.col("value").alias("given"))
    joined = buffers.join(given, (F.col("worker") == F.col("w")) & (F.col("slot") == F.col("s")), "left")
    return joined.select("worker", "slot", F.coalesce("given", "value").alias("value"))


def broadcast_to(source: DataFrame, workers: int) -> DataFrame:
    """(worker, slot, value): the same buffer (slot, value) for every worker."""
    return source.select(F.explode(F.expr(f"sequence(0L, {workers - 1}L)")).alias("worker"), "slot", "value")


def cardinality(workers: DataFrame) -> DataFrame:
    """nr_ranks and nr_workers of a set (w, enabled): ranks with an enabled worker, and enabled workers."""
    there = workers.where("enabled")
    return there.agg(F.countDistinct(F.expr(f"w div {RANK}")).alias("nr_ranks"), F.countDistinct("w").alias("nr_workers"))


def with_state(states: DataFrame, granularity: str, ids: list[int], state: int) -> DataFrame:
    """states (w, state) after state has been set for workers, for groups (rank * 8 + group) or for whole ranks."""
    key = {"dpu": "w", "ig": f"w div {RANK} * {GROUPS} + w % {GROUPS}", "rank": f"w div {RANK}"}[granularity]
    return states.select("w", F.when(F.expr(key).isin(ids), F.lit(state)).otherwise(F.col("state")).cast("int").alias("state"))


def called(workers: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, single: bool = False, nonblocking: bool = False, asynchronous: bool = False) -> DataFrame:
    """fn on each rank's rows (column w), or once on rank 0's. What doesn't block must be asynchronous; DataFrames are lazy, so both are."""
    if nonblocking and not asynchronous:
        raise ValueError("a call that doesn't block must be asynchronous")
    ranks = workers.withColumn("rank", F.expr(f"w div {RANK}"))
    return (ranks.where("rank = 0") if single else ranks).groupBy("rank").applyInPandas(fn, schema)


def nand_folded(rows: DataFrame, bits: int = 32, start: int = -1) -> DataFrame:
    """(g, f_nand): x = ~(x & v) over v in order of seq, from start, in so many bits; rows: (g, seq, v).

    A bit that is 0 in v sets the result's; each later 1 flips it. So it hangs
    on the last 0's place and the parity of what follows, both aggregates.
    """
    numbered = rows.withColumn("i", F.row_number().over(Window.partitionBy("g").orderBy("seq")).cast("long"))
    last = [F.max(F.when(F.expr(f"getbit(v, {b})") == 0, F.col("i"))).alias(f"z{b}") for b in range(bits)]
    found = numbered.groupBy("g").agg(F.count("*").alias("n"), *last)
    total: Column = F.lit(0).cast("long")
    for b in range(bits):
        own = F.when(F.col(f"z{b}").isNull(), (F.lit(start >> b & 1) + F.col("n")) % 2).otherwise((1 + F.col("n") - F.col(f"z{b}")) % 2)
        total = total + own * (1 << b)
    return found.select("g", total.cast("long").alias("f_nand"))


def compared_and_swapped(rows: DataFrame, start: int = 0) -> DataFrame:
    """(g, seq, swapped, held): compare-and-swap (g, seq, expected, new) in order of seq; a register is a sequence and runs through one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, start
        for batch in batches:
            out = []
            for g, seq, expected, new in zip(batch["g"], batch["seq"], batch["expected"], batch["new"]):
                if g != at:
                    at, held = g, start
                swapped = held == expected
                held = new if swapped else held
                out.append((g, seq, swapped, held))
            yield pd.DataFrame(out, columns=["g", "seq", "swapped", "held"])

    return rows.select("g", "seq", "expected", "new").repartition("g").sortWithinPartitions("g", "seq").mapInPandas(run, "g long, seq long, swapped boolean, held long")


def byte_updates(writes: DataFrame) -> DataFrame:
    """(address, value): what the last of the writes (address, seq, value) has left, whatever the order they come in."""
    return writes.groupBy("address").agg(F.max_by("value", "seq").alias("value"))


class Phases:
    """Seconds by phase on the driver; a phase that is entered again adds up."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    @contextmanager
    def timed(self, phase: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[phase] = self.seconds.get(phase, 0.0) + time.perf_counter() - began


def phase_totals(marks: DataFrame) -> DataFrame:
    """(worker, phase, n, total) of marks (worker, phase, seq, at): every second mark of a phase stops what the one before it started."""
    along = Window.partitionBy("worker", "phase").orderBy("seq")
    paired = marks.select("worker", "phase", F.row_number().over(along).alias("i"), (F.col("at") - F.lag("at").over(along)).alias("took")).where("i % 2 = 0")
    return paired.groupBy("worker", "phase").agg(F.count("*").alias("n"), F.sum("took").alias("total"))


def snapshot(parts: dict[str, DataFrame], spark: SparkSession) -> str:
    """Write the named tables to the shared folder; the path stands for the snapshot."""
    path = new_path(spark, "snapshot")
    for name, df in parts.items():
        df.write.parquet(f"{path}/{name}")
    return path


def restored(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


class WorkerSet:
    """Workers with named buffers: copy, run, call, gather, snapshot. Buffers are tables; nothing is held on the driver."""

    def __init__(self, spark: SparkSession, n: int):
        self.spark, self.n, self.buffers = spark, n, {}

    def __enter__(self) -> WorkerSet:
        return self

    def __exit__(self, *_) -> None:
        self.buffers = {}

    @property
    def workers(self) -> DataFrame:
        return self.spark.range(self.n).withColumnRenamed("id", "w")

    def ranks(self) -> int:
        return -(-self.n // RANK)

    def copy(self, name: str, rows: DataFrame) -> None:
        """Scatter rows with a column worker, or give rows without one to every worker."""
        self.buffers[name] = scattered(rows) if "worker" in rows.columns else broadcast_to(rows, self.n)

    def run(self, kernel: Callable[[pd.DataFrame], pd.DataFrame], source: str, target: str) -> None:
        """kernel on each worker's buffer (worker, slot, value), in order of slot."""
        placed = lambda own: kernel(own.sort_values("slot", ignore_index=True))
        self.buffers[target] = self.buffers[source].groupBy("worker").applyInPandas(placed, "worker long, slot long, value long")

    def call(self, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, **flags) -> DataFrame:
        return called(self.workers, fn, schema, **flags)

    def gather(self, name: str) -> DataFrame:
        return self.buffers[name]

    def checkpoint(self, *names: str) -> str:
        return snapshot({n: self.buffers[n] for n in names}, self.spark)

    def restore(self, path: str, *names: str) -> None:
        self.buffers |= restored(self.spark, path, *names)
