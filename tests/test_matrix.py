import numpy as np
import pytest

from quilt.operators import scheduling as S
from quilt.operators import tiling as T
from quilt.sources import files

RECORDS = [(1, 1), (3, 1), (2, 2), (4, 3), (1, 4), (4, 4)]


@pytest.fixture(scope="module")
def mtx(tmp_path_factory):
    path = tmp_path_factory.mktemp("mtx") / "m.mtx"
    path.write_text("% a comment\n4 4 6\n" + "".join(f"{c} {r} 9\n" for c, r in RECORDS))
    return str(path)


def test_text_scan_and_product(spark, mtx):
    m = files.read_mtx(spark, mtx)
    assert files.mtx_extent(spark, mtx) == (4, 4, 6)
    assert [r.val for r in m.orderBy("idx").collect()] == [1, 2, 3, 4, 1, 2]
    x = spark.range(4).selectExpr("id AS col", "CAST(id % 4 + 1 AS DOUBLE) AS x")
    want = [7, 6, 16, 9]
    assert [r.y for r in T.spmv(m, x).orderBy("row").collect()] == want
    for height, width in ((2, 2), (1, 4), (3, 1)):
        t = T.tiled(m, height, width, -(-4 // width))
        assert [r.y for r in T.spmv(t, x, "p").orderBy("row").collect()] == want
    assert [r.y for r in T.dense(T.spmv(m.where("row = 2"), x), 4).orderBy("row").collect()] == [0, 0, 16, 0]
    assert {r.p: r["count"] for r in T.tiled(m, 2, 2, 2).groupBy("p").count().collect()} == {0: 2, 1: 1, 2: 1, 3: 2}


def test_empty_matrix(spark):
    m = spark.createDataFrame([], "row long, col long, val double")
    assert T.extent(m) == (0, 0)
    assert T.row_pointers(T.tiled(m, 2, 2, 2), "p", "local_row").count() == 0


def test_splits_match_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    counts = [(t, r, int(rng.integers(0, 9))) for t in range(3) for r in range(40)]
    for granularity in (1, 2):
        want = {}
        for t in range(3):
            rows = [(r, k) for tt, r, k in counts if tt == t]
            limit, held, block = sum(k for _, k in rows) // 4, 0, 0
            for r, k in rows:
                lo, hi, n = want.get((t, block), (r, r, 0))
                want[t, block] = (lo, r, n + k)
                held += k
                if held >= limit and block < 3 and (r + 1) % granularity == 0:
                    held, block = 0, block + 1
        got = T.nnz_splits(spark.createDataFrame(counts, "tile long, row long, nnz long"), 4, granularity).collect()
        assert {(r.tile, r.block): (r.row_lo, r.row_hi, r.nnz) for r in got} == want


def test_binary_files(spark, tmp_path):
    ptr, per = [], []
    tiles = {0: [(0, 0, 1.0), (0, 1, 2.0)], 1: [(1, 0, 3.0)], 2: [], 3: [(0, 1, 4.0), (1, 1, 5.0)]}
    for p in range(4):
        rows = [r for r, _, _ in tiles[p]]
        ptr += np.searchsorted(rows, range(3)).tolist()
        per.append(len(rows))
    pad = [0] * (4 * 4 - len(ptr))
    flat = [x for p in range(4) for x in tiles[p]]
    body = [4, 4, 5, 2, 2, 4, 2, 2, *ptr, *pad, *[c for _, c, _ in flat]]
    (tmp_path / "d.bin").write_bytes(np.array(body, "<u4").tobytes() + np.array([v for *_, v in flat], "<f4").tobytes() + np.array(per, "<u4").tobytes())
    got = files.read_dcsr(spark, str(tmp_path / "d.bin")).collect()
    assert [tuple(r) for r in got] == [(p, r, c, v) for p in range(4) for r, c, v in tiles[p]]
    files.save_tiles(files.read_dcsr(spark, str(tmp_path / "d.bin")), str(tmp_path / "tiles"))
    assert files.load_tiles(spark, str(tmp_path / "tiles")).where("p = 3").count() == 2
    vert = [3, 4, 3, 4, 2, 2, 2, 2, 1, 0, 1, 1, 2, 0, 0, 1, 1, 0, 1, 1]
    (tmp_path / "r.bin").write_bytes(np.array(vert, "<u4").tobytes() + np.array([1, 2, 3], "<f4").tobytes())
    assert [tuple(r) for r in files.read_rbdcsr(spark, str(tmp_path / "r.bin")).collect()] == [(0, 0, 0, 1.0), (0, 2, 1, 2.0), (1, 1, 1, 3.0)]
    graph = np.array([3, 3, 4, 4, 2, 1, 1, 0, 2, 3, 4, 1, 2, 0, 0, 0, 2, 3], "<i4").tobytes() + bytes([1, 1, 1])
    (tmp_path / "g.bin").write_bytes(graph)
    nodes, edges, parts = files.read_graph(spark, str(tmp_path / "g.bin"), 2)
    assert [tuple(r) for r in nodes.collect()] == [(0, 0, True), (1, 0, True), (2, 1, True)]
    assert [tuple(r)[1:] for r in edges.collect()] == [(0, 1), (0, 2), (1, 0), (2, 0)]
    assert [tuple(r) for r in parts.collect()] == [(0, 0, 2), (1, 2, 3)]


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([(64, 1.0, 2.0, 3.0, 4.0, 5.0, 6.12345)], files.TIMING)
    for _ in range(2):
        files.append_timings(rows, str(tmp_path / "t"))
    assert files.read_timings(spark, str(tmp_path / "t")).count() == 2
    files.write_figures(rows, str(tmp_path / "f"))
    assert files.read_figures(spark, str(tmp_path / "f"), files.TIMING).first().total == 6.1235


def test_makespans(spark):
    costs = spark.createDataFrame([(0, 5), (1, 1), (2, 1), (3, 5), (4, 1), (5, 1)], "p long, cost long")
    assert S.bsp_makespan(costs, 2).first().makespan == 11
    assert S.on_demand_makespan(costs, 2).first().makespan == 7
    assert S.on_demand_makespan(costs, 2, 2).first().makespan == 11
