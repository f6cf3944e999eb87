"""Ring-buffer queues: geometry, replay of operation logs, waits of full queues, runs of resident kernels.

A queue has 2^ptr_size slots and two counters that only grow, read and write;
slots are their low bits. It is empty where the counters are equal and full
where written and reserved slots together are a whole ring ahead of the reader.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Largest ring, bytes that element sizes are multiples of, pushes tried and microseconds between them.
MOST_PTR_SIZE, ALIGN, RETRIES, WAIT_US = 10, 8, 1000, 10


def geometry(links: DataFrame) -> DataFrame:
    """links (queue, ptr_size, elem_bytes) with slots, buffer_bytes and whether such a queue may be made."""
    return links.selectExpr(
        "queue", "ptr_size", "elem_bytes", "shiftleft(1L, ptr_size) AS slots", "shiftleft(1L, ptr_size) * elem_bytes AS buffer_bytes",
        f"ptr_size BETWEEN 0 AND {MOST_PTR_SIZE} AND elem_bytes > 0 AND elem_bytes % {ALIGN} = 0 AS valid",
    )


def linked(links: DataFrame, retries: int = RETRIES, wait_us: int = WAIT_US) -> DataFrame:
    """Host end points of valid queues, an input and an output one each, with their retry policy."""
    ends = F.explode(F.array(F.lit("input"), F.lit("output"))).alias("direction")
    return geometry(links).where("valid").select("queue", ends, "slots", "buffer_bytes", F.lit(retries).cast("long").alias("max_retries"), F.lit(wait_us).cast("long").alias("wait_us"))


def replay(log: DataFrame, ptr_size: int) -> DataFrame:
    """(queue, seq, op, ok, slot, rd, wr, reserved, is_empty, is_full) after each operation of log (queue, seq, op).

    push and reserve fail on a full queue, pop and peek on an empty one, cede
    without a reservation; what fails changes nothing and has no slot. A queue
    is a sequence, so its log runs through one task, in batches, and only its
    counters are held.
    """
    slots = 1 << ptr_size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, rd, wr, held = None, 0, 0, 0
        for batch in batches:
            out = []
            for queue, seq, op in zip(batch["queue"], batch["seq"], batch["op"]):
                if queue != at:
                    at, rd, wr, held = queue, 0, 0, 0
                room, ok, slot = wr + held - rd < slots, False, None
                if op == "push" and room:
                    ok, slot, wr = True, wr % slots, wr + 1
                elif op in ("pop", "peek") and rd < wr:
                    ok, slot, rd = True, rd % slots, rd + (op == "pop")
                elif op == "reserve" and room:
                    ok, held = True, held + 1
                elif op == "cede" and held:
                    ok, held = True, held - 1
                out.append((queue, seq, op, ok, slot, rd, wr, held, rd == wr, wr + held - rd == slots))
            frame = pd.DataFrame(out, columns=["queue", "seq", "op", "ok", "slot", "rd", "wr", "reserved", "is_empty", "is_full"])
            yield frame.astype({"slot": "Int64"})

    ordered = log.select("queue", "seq", "op").repartition("queue").sortWithinPartitions("queue", "seq")
    return ordered.mapInPandas(run, "queue long, seq long, op string, ok boolean, slot long, rd long, wr long, reserved long, is_empty boolean, is_full boolean")


def waits(pushes: DataFrame, slots: int, service: int, retries: int, wait: int) -> DataFrame:
    """(queue, seq, pushed, retries, failed): when each element gets in and how often its push is tried again.

    pushes: (queue, seq, at). The reader needs ``service`` per element. An
    element ends at the latest of max over earlier ones of (arrival + service
    of all from there on), so running maxima take the place of a simulation;
    it gets in once the element a ring before it has ended. Failed ones are
    those that would need more than ``retries``.
    """
    along = Window.partitionBy("queue").orderBy("seq")
    numbered = pushes.withColumn("i", F.row_number().over(along).cast("long"))
    ends = F.max(F.col("at") - (F.col("i") - 1) * service).over(along.rowsBetween(Window.unboundedPreceding, 0)) + F.col("i") * service
    timed = numbered.withColumn("ends", ends).withColumn("pushed", F.greatest("at", F.lag("ends", slots).over(along)))
    tries = F.expr(f"(pushed - at + {wait - 1}) div {wait}")
    return timed.select("queue", "seq", "pushed", tries.alias("retries"), (tries > retries).alias("failed"))


def push_rounds(elements: DataFrame, workers: int) -> DataFrame:
    """(round, n, fast): elements (queue, seq) pushed one a queue and round; fast where every queue gets one, as all counters are then equal."""
    nth = F.row_number().over(Window.partitionBy("queue").orderBy("seq")) - 1
    return elements.select(nth.cast("long").alias("round")).groupBy("round").agg(F.count("*").alias("n")).withColumn("fast", F.col("n") == workers)


def resident_runs(states: DataFrame) -> DataFrame:
    """(worker, runs, exited): kernels run whenever state 2 is written, until 0 is; states: (worker, seq, state)."""
    ended = F.max((F.col("state") == 0).cast("int")).over(Window.partitionBy("worker").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    seen = states.withColumn("ended", ended)
    return seen.groupBy("worker").agg(F.count_if((F.col("ended") == 0) & (F.col("state") == 2)).alias("runs"), (F.max("ended") == 1).alias("exited"))
