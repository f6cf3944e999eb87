"""Ranks beyond one task: many blocks, ids that are dense or far apart, and no ranks sent through the driver."""

import random

import pytest
from pyspark.sql import functions as F

from quilt.operators import pagerank as P


@pytest.fixture(scope="module", params=[1, 10**9 + 7])
def graph(spark, request):
    draw = random.Random(4)
    far = request.param
    links = [(draw.randrange(40) * far, draw.randrange(40) ** 2 % 41 * far) for _ in range(300)]
    edges = spark.createDataFrame(links, "src long, dst long")
    nodes = edges.selectExpr("src AS n").union(edges.select("dst")).distinct().withColumn("sg", F.expr(f"n div ({far}L * 4)"))
    return edges.cache(), nodes.cache(), P.with_subgraphs(edges, nodes).cache()


def by(df, value):
    return [r[value] for r in df.orderBy(df.columns[0]).collect()]


@pytest.mark.parametrize("block, hub", [(4, 1), (16, 7)])
def test_blocks_do_as_one_task(graph, monkeypatch, block, hub):
    edges, nodes, placed = graph
    monkeypatch.setattr(P, "BLOCK", block)
    monkeypatch.setattr(P._dealt, "__defaults__", (hub,))
    assert by(P.flat(edges, nodes, 4, small=0), "r") == pytest.approx(by(P.flat(edges, nodes, 4), "r"), abs=1e-12)
    assert by(P.server_int(placed, nodes, 10000, 4, small=0), "srv") == by(P.server_int(placed, nodes, 10000, 4), "srv")
    assert by(P.global_boundary(placed, 3, small=0), "r") == pytest.approx(by(P.global_boundary(placed, 3), "r"), abs=1e-12)


def test_rounds_broadcast_nothing(graph):
    """A round's ranks went through the driver in a broadcast, so what it took grew with rounds and nodes."""
    edges, nodes, _ = graph
    ranks = P.flat(edges, nodes, 4, small=0)
    assert "Broadcast" not in ranks._jdf.queryExecution().executedPlan().toString()
