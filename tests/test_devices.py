"""Worker sets, queues and number formats where registered queries don't reach."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quilt.functions import numbers as N
from quilt.operators import workers as W
from quilt.session import Config
from quilt.sources import files
from quilt.streaming import ring


def test_calls(spark):
    workers = W.WorkerSet(spark, 130)
    assert workers.ranks() == 3
    fn = lambda own: pd.DataFrame({"n": [len(own)]})
    assert sorted(r.n for r in workers.call(fn, "n long").collect()) == [2, 64, 64]
    assert [r.n for r in workers.call(fn, "n long", single=True).collect()] == [64]
    with pytest.raises(ValueError):
        workers.call(fn, "n long", nonblocking=True)


def test_phases():
    phases = W.Phases()
    for _ in range(2):
        with phases.timed("exec"):
            pass
    assert set(phases.seconds) == {"exec"} and phases.seconds["exec"] >= 0


def test_run_parameters():
    assert Config.parsed(["-s", "7"]) == Config(subgraph_width=7)


def test_empty_tables(spark):
    log = spark.createDataFrame([], "queue long, seq long, op string")
    assert ring.replay(log, 2).count() == 0
    rows = spark.createDataFrame([], "worker long, seq long, value long")
    assert W.scattered(rows).count() == 0
    assert files._numbered(spark.createDataFrame([], "value string")).count() == 0


def test_half_floats(spark):
    """All 65,536 half floats there and back, as another library has them."""
    h = np.arange(65536, dtype=np.uint16)
    want = h.view(np.float16).astype(np.float64)
    got = spark.range(65536).select("id", N.extend_half(F.col("id")).alias("x")).withColumn("back", N.trunc_half(F.col("x"))).orderBy("id").toPandas()
    assert np.array_equal(got["x"].to_numpy(), want, equal_nan=True)
    numbers = ~np.isnan(want)
    assert np.array_equal(got["back"].to_numpy()[numbers], h[numbers])
    rng = np.random.default_rng(3)
    x = rng.normal(size=2000) * 10.0 ** rng.integers(-9, 6, 2000)
    with np.errstate(over="ignore"):
        bits = x.astype(np.float16).view(np.uint16)
    frame = spark.createDataFrame(pd.DataFrame({"i": range(2000), "x": x})).select("i", N.trunc_half(F.col("x")).alias("h")).orderBy("i").toPandas()
    assert np.array_equal(frame["h"].to_numpy(), bits)


def test_lines_are_numbered_over_partitions(spark, tmp_path):
    spark.range(1000).selectExpr("CAST(id AS STRING) AS value").repartitionByRange(7, "value").sortWithinPartitions("value").write.text(f"{tmp_path}/t")
    got = files._numbered(spark.read.text(f"{tmp_path}/t")).collect()
    assert sorted(r.idx for r in got) == list(range(1000)) and {r.value for r in got} == {str(i) for i in range(1000)}
