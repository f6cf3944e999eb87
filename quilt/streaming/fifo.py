"""FIFO processing as streams that drain what is there and stop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quilt.operators.store import new_path

TASKLETS = 4


def drain(spark: SparkSession, folder: str, pattern: str, work: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """Files of folder as a bounded input queue: work runs on each micro-batch, results are written, then the stream ends.

    Offsets and results stand in the shared folder, so a restarted stream goes
    on where it stopped. Order is not kept between elements.
    """
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    base = new_path(spark, label)
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 16).parquet(f"{folder}/{pattern}*")
    out = work(source)
    query = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def map_each(spark: SparkSession, d: str) -> DataFrame:
    """Every element by itself, in any order."""
    return drain(spark, d, "events.parquet", lambda e: e.select("event_id", (F.col("user_id") * 2 + 1).alias("v")), "fifo-map")


def fan_out(spark: SparkSession, d: str) -> DataFrame:
    """Each element handled by all tasklets (element + tasklet number), their results reduced to one."""

    def work(e: DataFrame) -> DataFrame:
        parts = F.transform(F.sequence(F.lit(0), F.lit(TASKLETS - 1)), lambda k: F.col("user_id") + k)
        return e.select("event_id", F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x).alias("v"))

    return drain(spark, d, "events.parquet", work, "fifo-fanout")
