"""Cutting lineage in iterative operators: a written table in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Session and path of what new_path has named and discard hasn't deleted.
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir; a local default only for local sessions."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file:///tmp/checkpoints"


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder; what is still there when the driver's process ends is deleted then."""
    path = f"{shared_dir(spark)}/quilt/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete what cut wrote for df, which nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        for entry in [e for e in _written if path.endswith(e[1].split(":", 1)[-1].lstrip("/"))]:
            _written.remove(entry)
            _delete(*entry)


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the driver's JVM has ended before its Python
            return
