"""Partitioned graph queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quilt.operators import pagerank as P
from quilt.operators.store import cut
from quilt.sources import adapters as A

#: Scale of the fixed-point ranks: the largest whose products stay below 2^63.
SCALE = 10**9
#: Ids of a subgraph.
WIDTH = 100
_BASE = f"{A.EDGES_SQL}, {A.NODES_SQL}"
_PLACED = f"{_BASE}, placed AS (SELECT src, dst, src // 100 AS ssg, dst // 100 AS dsg FROM edges)"
_CROSS = f"{_PLACED}, cr AS (SELECT * FROM placed WHERE ssg <> dsg)"
_Q = "CAST(floor({0} * 1e9 + 0.37) AS BIGINT)"


def _quantised(column):
    """Ranks in units of 1e-9, cut away from ties so that the order of sums can't show."""
    return F.floor(F.col(column) * 1e9 + 0.37).cast("long")


def _graph(spark, d):
    edges = cut(A.edges(spark, d), "edges")
    return edges, cut(A.nodes(edges, WIDTH), "nodes")


def _placed(spark, d):
    edges, nodes = _graph(spark, d)
    return P.with_subgraphs(edges, nodes, WIDTH), nodes


def graph_edges(spark, d):
    return A.edges(spark, d)


def node_subgraph(spark, d):
    return _graph(spark, d)[1]


def node_range_join(spark, d):
    """Nodes placed by a join with the subgraphs' ranges."""
    nodes = _graph(spark, d)[1].select("n")
    parts = nodes.select(F.expr("n div 100").alias("sg")).distinct().selectExpr("sg", "sg * 100 AS lo", "(sg + 1) * 100 AS hi")
    # Ranges are as wide as a bucket, so an equi-join on the bucket replaces the nested loop.
    return nodes.withColumn("bucket", F.expr("n div 100")).join(parts.withColumn("bucket", F.expr("lo div 100")), "bucket").where("n >= lo AND n < hi").select("n", "sg", "lo", "hi")


def icn_flags(spark, d):
    placed, nodes = _placed(spark, d)
    b = P.boundary_nodes(placed).select("n", F.lit(True).alias("is_icn"))
    return nodes.join(b, "n", "left").select("n", "sg", F.coalesce("is_icn", F.lit(False)).alias("is_icn"))


def icn_index(spark, d):
    rank = F.row_number().over(Window.partitionBy("sg").orderBy("n")) - 1
    return P.boundary_nodes(_placed(spark, d)[0]).select("n", "sg", rank.cast("long").alias("idx"))


def ice_list(spark, d):
    cross = _placed(spark, d)[0].where("ssg <> dsg")
    return cross.groupBy("src").agg(F.count("*").alias("n_ice"), F.concat_ws(",", F.transform(F.array_sort(F.collect_list("dst")), lambda x: x.cast("string"))).alias("dsts"))


def ice_count(spark, d):
    return _placed(spark, d)[0].where("ssg <> dsg").groupBy("ssg").agg(F.count("*").alias("n_ice"))


def cross_counts(spark, d):
    return _placed(spark, d)[0].where("ssg <> dsg").groupBy("dst", "ssg").agg(F.count("*").alias("k"))


def quotient_graph(spark, d):
    return P.quotient(_placed(spark, d)[0])


def partition_stats(spark, d):
    placed, nodes = _placed(spark, d)
    n = nodes.groupBy("sg").agg(F.count("*").alias("nodes"))
    e = placed.groupBy(F.col("ssg").alias("sg")).agg(F.count("*").alias("edges"))
    i = P.boundary_nodes(placed).groupBy("sg").agg(F.count("*").alias("icn"))
    all_ = n.join(e, "sg", "left").join(i, "sg", "left").na.fill(0)
    stats = [f(F.col(c)).alias(f"{k}_{c}") for c in ("nodes", "edges", "icn") for k, f in (("max", F.max), ("min", F.min))]
    even = [F.expr(f"(max({c}) + 1) div 2 * 2").alias(f"even_{c}") for c in ("nodes", "edges", "icn")]
    return all_.agg(*stats, *even, F.floor(F.avg("nodes")).alias("avg_nodes"), F.expr("sum(icn) * 1000 div sum(nodes)").alias("icn_permille"))


def pagerank_flat(spark, d):
    edges, nodes = _graph(spark, d)
    return P.flat(edges, nodes).select("n", _quantised("r").alias("r_q"))


def server_pr_float(spark, d):
    placed, nodes = _placed(spark, d)
    return P.server(placed, nodes).select("sg", _quantised("srv").alias("srv_q"))


def server_pr_int(spark, d):
    placed, nodes = _placed(spark, d)
    return P.server_int(placed, nodes, SCALE)


def local_pr(spark, d):
    placed, nodes = _placed(spark, d)
    return P.local(nodes, placed).select("n", "sg", _quantised("r").alias("r_q"))


def local_pr_step(spark, d):
    placed, nodes = _placed(spark, d)
    return P.local_native(nodes, placed, 1).select("n", "sg", _quantised("r").alias("r_q"))


def refinement(spark, d):
    placed, nodes = _placed(spark, d)
    return P.refinement(placed, P.server(placed, nodes)).select("n", _quantised("ref").alias("ref_q"))


def normalise(spark, d):
    placed, nodes = _placed(spark, d)
    return P.normalised(P.local(nodes, placed)).select("n", "sg", _quantised("r").alias("r_q"))


def hierarchical_pr(spark, d):
    edges, nodes = _graph(spark, d)
    return P.hierarchical(edges, nodes, width=WIDTH).select("n", "sg", _quantised("r").alias("r_q"))


def global_pr_icn(spark, d):
    return P.global_boundary(_placed(spark, d)[0]).select("n", _quantised("r").alias("r_q"))


def fused_sg_sum(spark, d):
    """Per-subgraph sum of the boundary nodes' global ranks, times local ranks."""
    placed, nodes = _placed(spark, d)
    placed = cut(placed, "placed")
    sums = P.global_boundary(placed).join(nodes, "n").groupBy("sg").agg(F.sum("r").alias("g"))
    return P.local(nodes, placed).join(sums, "sg").select("n", "sg", F.floor(F.col("r") * F.col("g") * 1e9 + 0.37).cast("long").alias("r_q"))


def pagerank_top(spark, d):
    edges, nodes = _graph(spark, d)
    return P.flat(edges, nodes).select("n", _quantised("r").alias("r_q")).orderBy(F.desc("r_q"), "n").limit(20)


def _loop(name: str, nodes: str, edges: str, rounds: int = 50) -> str:
    """Recursive CTE: nodes (n, base), edges (src, dst, w); ends in name(it, n, r)."""
    return f"""{name}_n AS ({nodes}), {name}_e AS ({edges}),
{name}(it, n, r, base) AS (SELECT 0, n, base, base FROM {name}_n
  UNION ALL SELECT a.it + 1, a.n, 0.15::DOUBLE * a.base + 0.85::DOUBLE * coalesce(b.s, 0), a.base
  FROM {name} a LEFT JOIN (SELECT e.dst, sum(x.r * e.w) AS s FROM {name} x JOIN {name}_e e ON x.n = e.src GROUP BY e.dst) b ON b.dst = a.n WHERE a.it < {rounds})"""


_FLAT = _loop("pr", "SELECT n, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS base FROM nodes", "SELECT src, dst, count(*)::DOUBLE / any_value(deg) AS w FROM (SELECT *, count(*) OVER (PARTITION BY src) AS deg FROM edges) GROUP BY src, dst")
_SRV = _loop("srv", "SELECT sg AS n, 1.0::DOUBLE / (SELECT count(DISTINCT sg) FROM nodes) AS base FROM (SELECT DISTINCT sg FROM nodes)", "SELECT ssg AS src, dsg AS dst, count(*)::DOUBLE / any_value(ice) AS w FROM (SELECT *, count(*) OVER (PARTITION BY ssg) AS ice FROM cr) GROUP BY ssg, dsg")


def _local_sql(rounds):
    return _loop("lo", "SELECT n, 1.0::DOUBLE / count(*) OVER (PARTITION BY sg) AS base FROM nodes", "SELECT src, dst, count(*)::DOUBLE / any_value(deg) AS w FROM (SELECT *, count(*) OVER (PARTITION BY src) AS deg FROM placed WHERE ssg = dsg) GROUP BY src, dst", rounds)


_REF = "ref AS (SELECT c.dst AS n, sum(a.r / b.r / c.ice) AS ref FROM (SELECT *, count(*) OVER (PARTITION BY ssg) AS ice FROM cr) c JOIN srv a ON a.n = c.ssg AND a.it = 50 JOIN srv b ON b.n = c.dsg AND b.it = 50 GROUP BY c.dst)"
_HIER = f"""WITH RECURSIVE {_CROSS}, {_SRV}, {_REF}, {_local_sql(50)},
mixed AS (SELECT l.n, l.n // 100 AS sg, l.base, l.r + coalesce(ref, 0) AS m FROM lo l LEFT JOIN ref ON ref.n = l.n WHERE l.it = 50),
norm AS (SELECT n, sg, base, m / sum(m) OVER (PARTITION BY sg) AS r FROM mixed),
last AS (SELECT a.n, a.sg, 0.15::DOUBLE * a.base + 0.85::DOUBLE * coalesce(b.s, 0) AS r FROM norm a LEFT JOIN (SELECT e.dst, sum(x.r * e.w) AS s FROM norm x JOIN lo_e e ON x.n = e.src GROUP BY e.dst) b ON b.dst = a.n)
SELECT last.n, last.sg, {_Q.format('(last.r * srv.r)')} AS r_q FROM last JOIN srv ON srv.n = last.sg AND srv.it = 50"""
_ICN = "icn AS (SELECT src AS n, ssg AS sg FROM cr UNION SELECT dst, dsg FROM cr)"

_GLOBAL = f"""{_ICN}, gn AS (SELECT n, (SELECT count(*) FROM icn) AS total FROM icn),
ge AS (SELECT src, dst, count(*)::DOUBLE / any_value(deg) AS w FROM (SELECT *, count(*) OVER (PARTITION BY src) AS deg FROM cr) GROUP BY src, dst),
gp(it, n, r, total) AS (SELECT 0, n, 1.0::DOUBLE / total, total FROM gn
  UNION ALL SELECT a.it + 1, a.n, 0.15::DOUBLE / a.total + coalesce(b.s, 0), a.total
  FROM gp a LEFT JOIN (SELECT e.dst, sum((x.r - 0.15::DOUBLE / x.total) * e.w) AS s FROM gp x JOIN ge e ON x.n = e.src GROUP BY e.dst) b ON b.dst = a.n WHERE a.it < 50),
gaps AS (SELECT a.it, least(sum(abs(a.r - b.r)), coalesce(sum(abs(a.r - c.r)), 1e300)) AS gap FROM gp a JOIN gp b ON b.n = a.n AND b.it = a.it - 1 LEFT JOIN gp c ON c.n = a.n AND c.it = a.it - 2 GROUP BY a.it),
settled AS (SELECT coalesce(min(it), 50) AS it FROM gaps WHERE gap <= 5.96e-8),
gr AS (SELECT n, r FROM gp JOIN settled ON settled.it = gp.it)"""

QUERIES = {f.__name__: f for f in (graph_edges, node_subgraph, node_range_join, icn_flags, icn_index, ice_list, ice_count, cross_counts, quotient_graph, partition_stats, pagerank_flat, pagerank_top, server_pr_float, server_pr_int, local_pr, local_pr_step, refinement, normalise, hierarchical_pr, global_pr_icn, fused_sg_sum)}
ORACLES = {
    "graph_edges": f"WITH {A.EDGES_SQL} SELECT * FROM edges",
    "node_subgraph": f"WITH {_BASE} SELECT n, sg FROM nodes",
    "node_range_join": f"WITH {_BASE}, parts AS (SELECT DISTINCT sg, sg * 100 AS lo, (sg + 1) * 100 AS hi FROM nodes) SELECT n, parts.sg, lo, hi FROM nodes JOIN parts ON n >= lo AND n < hi",
    "icn_flags": f"WITH {_CROSS}, {_ICN} SELECT n, sg, EXISTS (SELECT 1 FROM icn WHERE icn.n = nodes.n) AS is_icn FROM nodes",
    "icn_index": f"WITH {_CROSS}, {_ICN} SELECT n, sg, row_number() OVER (PARTITION BY sg ORDER BY n) - 1 AS idx FROM icn",
    "ice_list": f"WITH {_CROSS} SELECT src, count(*) AS n_ice, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS dsts FROM cr GROUP BY src",
    "ice_count": f"WITH {_CROSS} SELECT ssg, count(*) AS n_ice FROM cr GROUP BY ssg",
    "cross_counts": f"WITH {_CROSS} SELECT dst, ssg, count(*) AS k FROM cr GROUP BY dst, ssg",
    "quotient_graph": f"WITH {_CROSS} SELECT ssg, dsg, count(*) AS k, CAST(sum(count(*)) OVER (PARTITION BY ssg) AS BIGINT) AS ice FROM cr GROUP BY ssg, dsg",
    "partition_stats": f"""WITH {_CROSS}, {_ICN}, n AS (SELECT sg, count(*) AS nodes FROM nodes GROUP BY sg), e AS (SELECT ssg AS sg, count(*) AS edges FROM placed GROUP BY ssg), i AS (SELECT sg, count(*) AS icn FROM icn GROUP BY sg),
a AS (SELECT nodes, coalesce(edges, 0) AS edges, coalesce(icn, 0) AS icn FROM n LEFT JOIN e USING (sg) LEFT JOIN i USING (sg))
SELECT max(nodes) AS max_nodes, min(nodes) AS min_nodes, max(edges) AS max_edges, min(edges) AS min_edges, max(icn) AS max_icn, min(icn) AS min_icn, (max(nodes) + 1) // 2 * 2 AS even_nodes, (max(edges) + 1) // 2 * 2 AS even_edges, (max(icn) + 1) // 2 * 2 AS even_icn, CAST(floor(avg(nodes)) AS BIGINT) AS avg_nodes, CAST(sum(icn) * 1000 // sum(nodes) AS BIGINT) AS icn_permille FROM a""",
    "pagerank_flat": f"WITH RECURSIVE {_BASE}, {_FLAT} SELECT n, {_Q.format('r')} AS r_q FROM pr WHERE it = 50",
    "pagerank_top": f"WITH RECURSIVE {_BASE}, {_FLAT} SELECT n, {_Q.format('r')} AS r_q FROM pr WHERE it = 50 ORDER BY r_q DESC, n LIMIT 20",
    "server_pr_float": f"WITH RECURSIVE {_CROSS}, {_SRV} SELECT n AS sg, {_Q.format('r')} AS srv_q FROM srv WHERE it = 50",
    "server_pr_int": f"""WITH RECURSIVE {_CROSS}, q AS (SELECT ssg, dsg, count(*) AS k, CAST(sum(count(*)) OVER (PARTITION BY ssg) AS BIGINT) AS ice FROM cr GROUP BY ssg, dsg),
s AS (SELECT count(DISTINCT sg) AS s FROM nodes),
srv(it, sg, r) AS (SELECT 0, sg, {SCALE} // s FROM (SELECT DISTINCT sg FROM nodes), s
  UNION ALL SELECT a.it + 1, a.sg, {SCALE - SCALE * 85 // 100} // (SELECT s FROM s) + CAST({SCALE * 85 // 100} * coalesce(b.t, 0) // {SCALE} AS BIGINT)
  FROM srv a LEFT JOIN (SELECT q.dsg, sum(q.k * (x.r // q.ice)) AS t FROM srv x JOIN q ON q.ssg = x.sg GROUP BY q.dsg) b ON b.dsg = a.sg WHERE a.it < 50)
SELECT sg, r AS srv FROM srv WHERE it = 50""",
    "local_pr": f"WITH RECURSIVE {_PLACED}, {_local_sql(50)} SELECT n, n // 100 AS sg, {_Q.format('r')} AS r_q FROM lo WHERE it = 50",
    "local_pr_step": f"WITH RECURSIVE {_PLACED}, {_local_sql(1)} SELECT n, n // 100 AS sg, {_Q.format('r')} AS r_q FROM lo WHERE it = 1",
    "refinement": f"WITH RECURSIVE {_CROSS}, {_SRV}, {_REF} SELECT n, {_Q.format('ref')} AS ref_q FROM ref",
    "normalise": f"WITH RECURSIVE {_PLACED}, {_local_sql(50)}, z AS (SELECT n, n // 100 AS sg, r / sum(r) OVER (PARTITION BY n // 100) AS r FROM lo WHERE it = 50) SELECT n, sg, {_Q.format('r')} AS r_q FROM z",
    "hierarchical_pr": _HIER,
    "global_pr_icn": f"WITH RECURSIVE {_CROSS}, {_GLOBAL} SELECT n, {_Q.format('r')} AS r_q FROM gr",
    "fused_sg_sum": f"WITH RECURSIVE {_CROSS}, {_GLOBAL}, {_local_sql(50)}, g AS (SELECT n // 100 AS sg, sum(r) AS g FROM gr GROUP BY 1) SELECT lo.n, g.sg, {_Q.format('(lo.r * g.g)')} AS r_q FROM lo JOIN g ON g.sg = lo.n // 100 WHERE lo.it = 50",
}
