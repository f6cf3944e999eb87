"""The small graph whose answers were worked out apart from this library."""

import pytest
from pyspark.sql import functions as F

from quilt.operators import pagerank as P

EDGES = [(0, 1), (0, 2), (1, 2), (2, 0), (2, 3), (3, 4), (3, 5), (4, 5), (5, 3), (4, 1), (5, 0)]


@pytest.fixture(scope="module")
def graph(spark):
    edges = spark.createDataFrame(EDGES, "src long, dst long")
    nodes = spark.range(6).select(F.col("id").alias("n"), F.expr("id div 2").alias("sg"))
    return edges, nodes, P.with_subgraphs(edges, nodes).cache()


def by(df, key, value):
    return [r[value] for r in df.orderBy(key).collect()]


def test_flat(graph):
    edges, nodes, _ = graph
    assert by(P.flat(edges, nodes), "n", "r") == pytest.approx([0.18541586, 0.14791748, 0.22953159, 0.18541586, 0.10380174, 0.14791748], abs=1e-7)


def test_server(graph):
    _, nodes, placed = graph
    assert by(placed.where("ssg <> dsg").groupBy("ssg").count(), "ssg", "count") == [2, 3, 3]
    assert by(P.server(placed, nodes), "sg", "srv") == pytest.approx([0.32100819, 0.40148414, 0.27750768], abs=1e-7)
    assert by(P.server_int(placed, nodes, 10000), "sg", "srv") == [3203, 4006, 2769]


def test_refinement_and_local(graph):
    _, nodes, placed = graph
    ref = P.refinement(placed, P.server(placed, nodes))
    assert by(ref, "n", "ref") == pytest.approx([0.70506178, 0.28816261, 0.79955386, 0.23040153, 0.48224988, 0.48224988], abs=1e-7)
    kernel = by(P.local(nodes, placed), "n", "r")
    assert kernel == pytest.approx([0.075, 0.13875] * 3, abs=1e-9)
    assert by(P.local_native(nodes, placed, 3), "n", "r") == pytest.approx(by(P.local(nodes, placed, 3), "n", "r"), abs=1e-12)


def test_hierarchical(graph):
    edges, nodes, _ = graph
    assert by(P.hierarchical(edges, nodes), "n", "r") == pytest.approx([0.02407561, 0.20042176, 0.03011131, 0.27008098, 0.02081308, 0.13237257], abs=1e-7)


def test_boundary(graph):
    _, _, placed = graph
    assert by(P.boundary_nodes(placed), "n", "n") == list(range(6))


def test_global_boundary_matches_plain_loop(graph):
    """Six nodes, eight cross edges: the loop in plain Python."""
    _, _, placed = graph
    cross = [(r.src, r.dst) for r in placed.where("ssg <> dsg").collect()]
    out = {s: sum(x == s for x, _ in cross) for s, _ in cross}
    rank, earlier, init = {n: 1 / 6 for n in range(6)}, None, 0.15 / 6
    for _ in range(50):
        after = dict.fromkeys(range(6), init)
        for s, d in cross:
            after[d] += (rank[s] - init) / out[s]
        gaps = [sum(abs(after[n] - o[n]) for n in after) for o in (rank, earlier) if o]
        earlier, rank = rank, after
        if min(gaps) <= 5.96e-8:
            break
    assert by(P.global_boundary(placed), "n", "r") == pytest.approx([rank[n] for n in range(6)], abs=1e-12)


def test_many_tasks_do_as_one(graph, monkeypatch):
    """Beyond the size of one task, and with every source a hub, ranks are the same."""
    edges, nodes, placed = graph
    monkeypatch.setattr(P, "HUB", 1)
    monkeypatch.setattr(P._dealt, "__defaults__", (1,))
    assert by(P.flat(edges, nodes, 12, small=0), "n", "r") == pytest.approx(by(P.flat(edges, nodes, 12), "n", "r"), abs=1e-12)
    assert by(P.server_int(placed, nodes, 10000, 12, small=0), "sg", "srv") == by(P.server_int(placed, nodes, 10000, 12), "sg", "srv")
    assert by(P.global_boundary(placed, 12, small=0), "n", "r") == pytest.approx(by(P.global_boundary(placed, 12), "n", "r"), abs=1e-12)
    assert sorted(map(tuple, P.with_subgraphs(edges, nodes, 2).collect())) == sorted(map(tuple, placed.collect()))
