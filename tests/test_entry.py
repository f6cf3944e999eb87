"""Registered queries against their SQL on the smallest tables, a few of each group."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
NAMES = ["spmv_tiled", "nnz_split", "tile_descriptors", "icn_index", "server_pr_int", "hierarchical_pr", "str_strcmp", "str_strtok", "math_mul", "math_ucmp", "finished_bitmap_dpu", "pivot_speedup", "fifo_fanout_reduce", "fifo_peek_pop", "fifo_waits", "xfer_gather", "atomic_nand", "dcsr_file", "mtx_text", "graph_file", "matrix_equal", "ondemand_makespan_ig", "math_umod", "math_complex_inf_re"]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, tables, name):
    got = __spark_entry__.queries()[name](spark, SF)
    want = tables.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    assert sorted(repr([r[c] for c in order]) for r in got.collect()) == sorted(repr([dict(zip(names, r))[c] for c in order]) for r in want.fetchall())


def test_core_without_the_subpackage():
    """Where something that the subpackage needs is missing, everything else is there."""
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert 'spmv_tiled' in q and 'pipeline' not in q and not any(n.startswith('op1') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(__spark_entry__.__file__))
