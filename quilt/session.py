"""Session factory and the few settings that operators read."""

from __future__ import annotations

import argparse
import os
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Config:
    """Run parameters: subgraph width, worker count, PageRank constants and tile grid."""

    subgraph_width: int = 100
    workers: int = 64
    damping: float = 0.85
    iterations: int = 50
    tiles_h: int = 16
    tiles_v: int = 16

    @classmethod
    def parsed(cls, args: list[str]) -> Config:
        """Parameters from a command line: -s width, -d workers, -n iterations, -v and -f tiles along columns and rows."""
        parser = argparse.ArgumentParser()
        flags = {"-s": "subgraph_width", "-d": "workers", "-n": "iterations", "-v": "tiles_v", "-f": "tiles_h"}
        for flag, name in flags.items():
            parser.add_argument(flag, dest=name, type=int, default=getattr(cls, name))
        return cls(**vars(parser.parse_args(args)))


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quilt")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("QUILT_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
