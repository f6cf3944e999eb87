"""How assigning partitions to workers shapes the makespan: barrier waves against on-demand pulls."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bsp_makespan(costs: DataFrame, workers: int) -> DataFrame:
    """Waves of ``workers`` partitions in order of p; each lasts as long as its longest."""
    waves = costs.groupBy(F.expr(f"p div {workers}").alias("wave")).agg(F.max("cost").alias("longest"))
    return waves.agg(F.count("*").alias("waves"), F.coalesce(F.sum("longest"), F.lit(0)).cast("long").alias("makespan"))


def on_demand_makespan(costs: DataFrame, workers: int, group: int = 1) -> DataFrame:
    """Groups of workers pull the next ``group`` partitions when all of theirs are done; greedy in order of p.

    The partitions' costs are one row each (as many as tiles); the simulation
    is sequential by nature and runs in one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf.sort_values("p")["cost"].tolist()
        free = [(0, i) for i in range(max(1, workers // group))]
        for at in range(0, len(c), group):
            t, i = heapq.heappop(free)
            heapq.heappush(free, (t + max(c[at : at + group]), i))
        return pd.DataFrame({"makespan": [max(t for t, _ in free)]})

    return costs.select("p", "cost").groupBy().applyInPandas(run, "makespan long")


def wave_assignment(parts: DataFrame, workers: int) -> DataFrame:
    """Wave and slot of partitions when lower workers take the first vertical tile and upper ones the second.

    parts: (p, n) with n the number of partitions of both tiles together.
    """
    half = workers // 2
    return parts.selectExpr("p", f"(p % (n div 2)) div {half} AS wave", f"(p % (n div 2)) % {half} + CASE WHEN p < n div 2 THEN 0 ELSE {half} END AS worker")


def finished_bitmap(states: DataFrame, granularity: str = "dpu") -> DataFrame:
    """(rank, bitmap, n): finished workers of each rank of 64; w counts workers, state 1 is finished.

    dpu: a bit per worker, set once both of its even/odd pair are done. ig: a
    bit per interleaving group (w % 8), set once all of it are done. rank: bit
    0 once all 64 are.
    """
    placed = states.selectExpr("w div 64 AS rank", "w % 64 AS i", "state")
    if granularity == "dpu":
        pairs = placed.groupBy("rank", F.expr("i div 2").alias("g")).agg(F.min((F.col("state") == 1).cast("int")).alias("done"), F.bit_or(F.expr("shiftleft(1L, int(i))")).alias("bits"))
    elif granularity == "ig":
        pairs = placed.groupBy("rank", F.expr("i % 8").alias("g")).agg(F.min((F.col("state") == 1).cast("int")).alias("done")).withColumn("bits", F.expr("shiftleft(1L, int(g))"))
    else:
        pairs = placed.groupBy("rank").agg((F.sum((F.col("state") == 1).cast("int")) == 64).cast("int").alias("done")).withColumn("bits", F.lit(1).cast("long"))
    found = pairs.groupBy("rank").agg(F.bit_or(F.when(F.col("done") == 1, F.col("bits")).otherwise(F.lit(0).cast("long"))).alias("bitmap"))
    return found.select("rank", "bitmap", F.bit_count("bitmap").cast("long").alias("n"))
