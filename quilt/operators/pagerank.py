"""Flat and hierarchical PageRank over edge bags; sources without out-edges pass nothing on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quilt.operators.store import cut

DAMPING = 0.85
ITERATIONS = 50
CUT_EVERY = 10
#: Nodes and edges together, as counted, up to which all rounds run in one task (some 100 MB).
SMALL = 2_000_000
#: Places of a block, whose ranks are one array.
BLOCK = 1 << 16
#: Edges out of one block that stand under one key.
HUB = 1_000_000


def propagate(nodes: DataFrame, edges: DataFrame, rounds: int, damping: float = DAMPING, small: int = SMALL) -> DataFrame:
    """(n, r) after rounds of r(n) = (1 - d) * base(n) + d * sum over edges of r(src) * w.

    nodes: (n, base); edges: (src, dst, w), parallel edges already summed. Up
    to ``small`` measured rows all rounds run in one task; beyond that edges
    are dealt by blocks of sources once, and only arrays of ranks and of sums
    are shuffled (see _dealt).
    """
    if nodes.count() + edges.count() <= small:

        def kernel(own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
            ids, order = own["n"].to_numpy(), np.argsort(own["n"].to_numpy())
            at = lambda column: order[np.searchsorted(ids, links[column].to_numpy(), sorter=order)]
            base, s, d, w = own["base"].to_numpy(), at("src"), at("dst"), links["w"].to_numpy()
            rank = base
            for _ in range(rounds):
                rank = (1 - damping) * base + damping * np.bincount(d, weights=rank[s] * w, minlength=len(base))
            return pd.DataFrame({"n": ids, "r": rank})

        return _in_one_task(nodes.select("n", "base"), edges.select("src", "dst", "w"), "n long, r double", kernel)
    dealt = _dealt(nodes.select("n", "base"), edges.select("src", "dst", "w"))
    now = dealt.first()
    for i in range(rounds):
        now = dealt.after(now, lambda r, w: r * w, lambda base, sums: (1 - damping) * base + damping * sums)
        if (i + 1) % CUT_EVERY == 0 and i + 1 < rounds:
            now = cut(now, "ranks")
    return dealt.ranks(now)


def _in_one_task(nodes: DataFrame, edges: DataFrame, schema: str, kernel) -> DataFrame:
    """Both tables, of a measured size, brought together in one task."""
    one = F.lit(0).alias("one")
    columns, links = nodes.columns, edges.columns
    grouped = nodes.select(one, *columns).groupBy("one").cogroup(edges.select(one, *links).groupBy("one"))
    return grouped.applyInPandas(lambda own, found: kernel(own[columns], found[links]), schema)


def _numbered(nodes: DataFrame) -> DataFrame:
    """(n, at): ids by their place in order, counted per range of ids and then over ranges."""
    placed = cut(nodes.select("n").repartitionByRange("n").withColumn("part", F.spark_partition_id()), "numbers")
    starts, at = [], 0
    for r in sorted(placed.groupBy("part").count().collect(), key=lambda r: r["part"]):  # a number a partition
        starts.append((r["part"], at))
        at += r["count"]
    starts = nodes.sparkSession.createDataFrame(starts, "part int, before long")
    inside = F.row_number().over(Window.partitionBy("part").orderBy("n")) - 1
    return placed.withColumn("inside", inside).join(F.broadcast(starts), "part").select("n", (F.col("before") + F.col("inside")).alias("at"))


@dataclass(frozen=True)
class _Dealt:
    """Edges and nodes as arrays in rows, and the rounds over them.

    edges: (b, salt, s, to, first, values): those out of block b under a key,
    sorted by destination; s are their sources' places in the block, ``to`` the
    places of destinations and ``first`` where each one's edges begin. nodes:
    (b, fan, ids, at, base). They are dealt over ``parts`` and ``spread`` tasks. Ranks are (b, salt, r): all of a block's places,
    once for each key of its edges.
    """

    edges: DataFrame
    nodes: DataFrame
    parts: int
    spread: int
    values: dict[str, np.dtype]
    dtype: np.dtype

    def first(self) -> DataFrame:
        """Ranks before the first round, the nodes' base."""
        dtype = self.dtype

        def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
            return _rows(key[0], own, np.frombuffer(own["base"].iloc[0], dtype))

        return self.nodes.groupBy("b").applyInPandas(run, "b long, salt int, r binary")

    def after(self, now: DataFrame, move: Callable, settle: Callable) -> DataFrame:
        """Ranks after a round: settle(base, sums) for nodes, of move(source's rank, *values) for edges.

        No join, so no table of ranks is broadcast through the driver.
        """
        values, dtype = self.values, self.dtype

        def send(key: tuple, links: pd.DataFrame, ranks: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(links) and len(ranks):
                link = links.iloc[0]
                rank = np.frombuffer(ranks["r"].iloc[0], dtype)[np.frombuffer(link["s"], np.int32)]
                moved = move(rank, *(np.frombuffer(link[c], t) for c, t in values.items()))
                sums = np.add.reduceat(moved, np.frombuffer(link["first"], np.int64))
                to = np.frombuffer(link["to"], np.int64)
                blocks, starts = np.unique(to // BLOCK, return_index=True)
                for block, lo, hi in zip(blocks, starts, [*starts[1:], len(to)]):
                    found.append((block, (to[lo:hi] % BLOCK).astype(np.int32).tobytes(), sums[lo:hi].tobytes()))
            return pd.DataFrame(found, columns=["b", "at", "sums"])

        def receive(key: tuple, own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
            if not len(own):
                return pd.DataFrame({"b": [], "salt": [], "r": []})
            sums = np.zeros(BLOCK, dtype)
            for at, part in zip(found["at"], found["sums"]):
                sums[np.frombuffer(at, np.int32)] += np.frombuffer(part, dtype)
            at, base = np.frombuffer(own["at"].iloc[0], np.int32), np.frombuffer(own["base"].iloc[0], dtype)
            return _rows(key[0], own, settle(base, sums[at]))

        there = now.repartition(self.parts, "b", "salt")
        sums = self.edges.groupBy("b", "salt").cogroup(there.groupBy("b", "salt")).applyInPandas(send, "b long, at binary, sums binary")
        sums = sums.repartition(self.spread, "b")
        return self.nodes.groupBy("b").cogroup(sums.groupBy("b")).applyInPandas(receive, "b long, salt int, r binary")

    def ranks(self, now: DataFrame) -> DataFrame:
        """(n, r)"""
        dtype = self.dtype

        def run(own: pd.DataFrame, ranks: pd.DataFrame) -> pd.DataFrame:
            at = np.frombuffer(own["at"].iloc[0], np.int32)
            return pd.DataFrame({"n": np.frombuffer(own["ids"].iloc[0], np.int64), "r": np.frombuffer(ranks["r"].iloc[0], dtype)[at]})

        return self.nodes.groupBy("b").cogroup(now.where("salt = 0").groupBy("b")).applyInPandas(run, f"n long, r {'double' if dtype == np.float64 else 'long'}")

    def gap(self, one: DataFrame, other: DataFrame) -> float:
        """Sum of the differences of ranks."""
        dtype = self.dtype

        def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"gap": [float(np.abs(np.frombuffer(a["r"].iloc[0], dtype) - np.frombuffer(b["r"].iloc[0], dtype)).sum())]})

        found = one.where("salt = 0").groupBy("b").cogroup(other.where("salt = 0").groupBy("b")).applyInPandas(run, "gap double")
        return found.agg(F.sum("gap")).first()[0] or 0.0


def _rows(block: int, own: pd.DataFrame, ranks: np.ndarray) -> pd.DataFrame:
    """Ranks of a block's nodes, at their places, once for each key of its edges."""
    everywhere = np.zeros(BLOCK, ranks.dtype)
    everywhere[np.frombuffer(own["at"].iloc[0], np.int32)] = ranks
    fan = int(own["fan"].iloc[0])
    return pd.DataFrame({"b": [block] * fan, "salt": range(fan), "r": [everywhere.tobytes()] * fan})


def _dealt(nodes: DataFrame, edges: DataFrame, hub: int = HUB) -> _Dealt:
    """Edges as arrays, dealt once for all rounds by blocks of BLOCK sources.

    nodes: (n, base); edges: (src, dst, values that a round needs). A node's
    place is its id less the least one where ids are dense, else its number in
    order. A block with more than ``hub`` edges is dealt over fan keys by
    destinations, so no task holds a hub's edges alone; its ranks are repeated
    for each key. What is kept in memory or on an executor's disk is made anew
    from the written arrays if the executor is lost.
    """
    types = {"double": np.dtype(np.float64), "bigint": np.dtype(np.int64)}
    values = {c: types[t] for c, t in edges.dtypes if c not in ("src", "dst")}
    dtype = types[dict(nodes.dtypes)["base"]]
    least, most, n = nodes.agg(F.min("n"), F.max("n"), F.count("*")).first()
    if most - least < 4 * n:
        nodes = nodes.withColumn("at", F.col("n") - least)
        edges = edges.select((F.col("src") - least).alias("s"), (F.col("dst") - least).alias("d"), *values)
    else:
        at = cut(_numbered(nodes), "places")
        nodes = nodes.join(at, "n")
        edges = edges.join(at.select(F.col("n").alias("src"), F.col("at").alias("s")), "src").join(at.select(F.col("n").alias("dst"), F.col("at").alias("d")), "dst").select("s", "d", *values)
    block = f"CAST(s div {BLOCK} AS LONG)"
    fans = cut(edges.groupBy(F.expr(block).alias("b")).agg(F.ceil(F.count("*") / hub).cast("int").alias("fan")), "fans")
    most_parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(most_parts, fans.agg(F.sum("fan")).first()[0] or 0))
    salted = edges.withColumn("b", F.expr(block)).join(fans, "b").select("b", F.pmod(F.xxhash64("d"), F.col("fan")).cast("int").alias("salt"), "s", "d", *values)

    def pack(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("d", ignore_index=True)
        to, first = np.unique(own["d"].to_numpy(), return_index=True)
        arrays = {"s": (own["s"] % BLOCK).to_numpy().astype(np.int32), "to": to, "first": first.astype(np.int64)} | {c: own[c].to_numpy() for c in values}
        return pd.DataFrame({"b": [key[0]], "salt": [key[1]]} | {c: [a.tobytes()] for c, a in arrays.items()})

    def hold(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        arrays = {"ids": own["n"].to_numpy(), "at": (own["at"] % BLOCK).to_numpy().astype(np.int32), "base": own["base"].to_numpy()}
        return pd.DataFrame({"b": [key[0]], "fan": [own["fan"].iloc[0]]} | {c: [a.tobytes()] for c, a in arrays.items()})

    packed = salted.repartition(parts, "b", "salt").groupBy("b", "salt").applyInPandas(pack, "b long, salt int, s binary, to binary, first binary" + "".join(f", {c} binary" for c in values))
    placed = nodes.withColumn("b", F.expr(f"CAST(at div {BLOCK} AS LONG)")).join(fans, "b", "left").na.fill({"fan": 1})
    held = cut(placed.groupBy("b").applyInPandas(hold, "b long, fan int, ids binary, at binary, base binary"), "blocks")
    spread = max(1, min(most_parts, held.count()))
    return _Dealt(cut(packed, "dealt").repartition(parts, "b", "salt").persist(), held.repartition(spread, "b").persist(), parts, spread, values, dtype)


def weighted(edges: DataFrame) -> DataFrame:
    """(src, dst, w): parallel edges summed, w their share of the source's out-edges."""
    counts = edges.groupBy("src", "dst").agg(F.count("*").alias("k"))
    return counts.withColumn("w", F.col("k") / F.sum("k").over(Window.partitionBy("src"))).select("src", "dst", "w")


def flat(edges: DataFrame, nodes: DataFrame, rounds: int = ITERATIONS, small: int = SMALL) -> DataFrame:
    n = nodes.count()
    return propagate(nodes.select("n", F.lit(1.0 / max(n, 1)).alias("base")), cut(weighted(edges), "edges"), rounds, small=small)


def with_subgraphs(edges: DataFrame, nodes: DataFrame, width: int | None = None) -> DataFrame:
    """(src, dst, ssg, dsg); width: subgraphs are ranges of so many ids, so no join is needed."""
    if width:
        return edges.selectExpr("src", "dst", f"src div {width} AS ssg", f"dst div {width} AS dsg")
    s = nodes.select(F.col("n").alias("src"), F.col("sg").alias("ssg"))
    d = nodes.select(F.col("n").alias("dst"), F.col("sg").alias("dsg"))
    return edges.join(s, "src").join(d, "dst").select("src", "dst", "ssg", "dsg")


def quotient(placed: DataFrame) -> DataFrame:
    """(ssg, dsg, k, ice): cross edges between subgraphs and each source's total."""
    k = placed.where("ssg <> dsg").groupBy("ssg", "dsg").agg(F.count("*").alias("k"))
    return k.withColumn("ice", F.sum("k").over(Window.partitionBy("ssg")))


def server(placed: DataFrame, nodes: DataFrame, rounds: int = ITERATIONS, small: int = SMALL) -> DataFrame:
    """(sg, srv): PageRank of the subgraphs."""
    parts = nodes.select(F.col("sg").alias("n")).distinct()
    s = parts.count()
    q = cut(quotient(placed).select(F.col("ssg").alias("src"), F.col("dsg").alias("dst"), (F.col("k") / F.col("ice")).alias("w")), "quotient")
    return propagate(cut(parts.select("n", F.lit(1.0 / max(s, 1)).alias("base")), "parts"), q, rounds, small=small).select(F.col("n").alias("sg"), F.col("r").alias("srv"))


def server_int(placed: DataFrame, nodes: DataFrame, scale: int, rounds: int = ITERATIONS, small: int = SMALL) -> DataFrame:
    """(sg, srv): the same in whole numbers, every division truncating."""
    parts = cut(nodes.select("sg").distinct(), "parts")
    s = max(parts.count(), 1)
    damp = scale * 85 // 100
    q = cut(quotient(placed), "quotient")
    if s + q.count() <= small:

        def kernel(own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
            ids = np.sort(own["sg"].to_numpy())
            a, b = np.searchsorted(ids, links["ssg"].to_numpy()), np.searchsorted(ids, links["dsg"].to_numpy())
            k, ice, rank = links["k"].to_numpy(), links["ice"].to_numpy(), np.full(len(ids), scale // s, dtype=np.int64)
            for _ in range(rounds):
                moved = np.zeros(len(ids), dtype=np.int64)
                np.add.at(moved, b, k * (rank[a] // ice))
                rank = (scale - damp) // s + damp * moved // scale
            return pd.DataFrame({"sg": ids, "srv": rank})

        return _in_one_task(parts, q, "sg long, srv long", kernel)
    dealt = _dealt(parts.select(F.col("sg").alias("n"), F.lit(scale // s).cast("long").alias("base")), q.select(F.col("ssg").alias("src"), F.col("dsg").alias("dst"), "k", "ice"))
    now = dealt.first()
    for i in range(rounds):
        now = dealt.after(now, lambda r, k, ice: k * (r // ice), lambda base, moved: (scale - damp) // s + damp * moved // scale)
        if (i + 1) % CUT_EVERY == 0 and i + 1 < rounds:
            now = cut(now, "ranks")
    return dealt.ranks(now).select(F.col("n").alias("sg"), F.col("r").alias("srv"))


def refinement(placed: DataFrame, srv: DataFrame) -> DataFrame:
    """(n, ref): what cross edges bring in; pairs that are absent bring 0, as do subgraphs without cross edges."""
    ice = placed.where("ssg <> dsg").groupBy("ssg").agg(F.count("*").alias("ice"))
    cross = placed.where("ssg <> dsg").groupBy("dst", "ssg", "dsg").agg(F.count("*").alias("k"))
    a, b = srv.select(F.col("sg").alias("ssg"), F.col("srv").alias("s_from")), srv.select(F.col("sg").alias("dsg"), F.col("srv").alias("s_own"))
    joined = cross.join(ice, "ssg").join(a, "ssg").join(b, "dsg")
    return joined.groupBy(F.col("dst").alias("n")).agg(F.sum(F.col("s_from") / F.col("s_own") * F.col("k") / F.col("ice")).alias("ref"))


def _local_ranks(nodes: np.ndarray, src: np.ndarray, dst: np.ndarray, rounds: int, damping: float, start: np.ndarray | None = None) -> np.ndarray:
    k = len(nodes)
    s, d = np.searchsorted(nodes, src), np.searchsorted(nodes, dst)
    deg = np.bincount(s, minlength=k)
    rank = np.full(k, 1.0 / k) if start is None else start
    for _ in range(rounds):
        rank = (1 - damping) / k + damping * np.bincount(d, weights=rank[s] / deg[s], minlength=k)
    return rank


def _per_subgraph(nodes: DataFrame, placed: DataFrame, schema: str, kernel) -> DataFrame:
    """One shuffle brings a subgraph's nodes and inner edges together; all rounds run inside its task."""
    inner = placed.where("ssg = dsg").select(F.col("ssg").alias("sg"), "src", "dst")

    def run(own: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("n", ignore_index=True)
        return kernel(own, edges["src"].to_numpy(), edges["dst"].to_numpy())

    return nodes.groupBy("sg").cogroup(inner.groupBy("sg")).applyInPandas(run, schema)


def local(nodes: DataFrame, placed: DataFrame, rounds: int = ITERATIONS, damping: float = DAMPING) -> DataFrame:
    """(n, sg, r): PageRank inside each subgraph."""

    def kernel(own, src, dst):
        return own[["n", "sg"]].assign(r=_local_ranks(own["n"].to_numpy(), src, dst, rounds, damping))

    return _per_subgraph(nodes.select("n", "sg"), placed, "n long, sg long, r double", kernel)


def local_native(nodes: DataFrame, placed: DataFrame, rounds: int, damping: float = DAMPING) -> DataFrame:
    """local by DataFrame operations alone, one join and one sum a round."""
    base = nodes.select("n", "sg", (1.0 / F.count("*").over(Window.partitionBy("sg"))).alias("base"))
    inner = weighted(placed.where("ssg = dsg").select("src", "dst"))
    return propagate(base.select("n", "base"), cut(inner, "edges"), rounds, damping).join(nodes, "n").select("n", "sg", "r")


def normalised(ranks: DataFrame) -> DataFrame:
    """r divided by its subgraph's sum."""
    return ranks.withColumn("r", F.col("r") / F.sum("r").over(Window.partitionBy("sg")))


def hierarchical(edges: DataFrame, nodes: DataFrame, rounds: int = ITERATIONS, damping: float = DAMPING, width: int | None = None) -> DataFrame:
    """(n, sg, r): local ranks, refined by cross edges, normalised, one more round, times the subgraph's rank."""
    placed = cut(with_subgraphs(edges, nodes, width), "placed")
    srv = cut(server(placed, nodes, rounds), "server")
    refined = nodes.join(refinement(placed, srv), "n", "left").select("n", "sg", F.coalesce("ref", F.lit(0.0)).alias("ref"))

    def kernel(own, src, dst):
        ids = own["n"].to_numpy()
        mixed = _local_ranks(ids, src, dst, rounds, damping) + own["ref"].to_numpy()
        return own[["n", "sg"]].assign(r=_local_ranks(ids, src, dst, 1, damping, mixed / mixed.sum()))

    fused = _per_subgraph(refined, placed, "n long, sg long, r double", kernel)
    return fused.join(srv, "sg").select("n", "sg", (F.col("r") * F.col("srv")).alias("r"))


def boundary_nodes(placed: DataFrame) -> DataFrame:
    """(n, sg): sources and destinations of cross edges."""
    cross = placed.where("ssg <> dsg")
    return cross.select(F.col("src").alias("n"), F.col("ssg").alias("sg")).union(cross.select("dst", "dsg")).distinct()


def global_boundary(placed: DataFrame, rounds: int = ITERATIONS, tolerance: float = 5.96e-8, damping: float = DAMPING, small: int = SMALL) -> DataFrame:
    """(n, r): PageRank among boundary nodes, shares by their cross edges; stops when ranks settle.

    A node's movable rank is its rank less its start, spread over its cross
    edges; settling is measured against the last and the last but one round.
    """
    icn = cut(boundary_nodes(placed), "boundary")
    total = max(icn.count(), 1)
    init = (1 - damping) / total
    edges = cut(weighted(placed.where("ssg <> dsg").select("src", "dst")), "edges")
    if total + edges.count() <= small:

        def kernel(own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
            ids = np.sort(own["n"].to_numpy())
            a, b, w = np.searchsorted(ids, links["src"].to_numpy()), np.searchsorted(ids, links["dst"].to_numpy()), links["w"].to_numpy()
            now, earlier = np.full(len(ids), 1.0 / total), None
            for _ in range(rounds):
                after = init + np.bincount(b, weights=(now[a] - init) * w, minlength=len(ids))
                gaps = [np.abs(after - old).sum() for old in (now, earlier) if old is not None]
                earlier, now = now, after
                if min(gaps) <= tolerance:
                    break
            return pd.DataFrame({"n": ids, "r": now})

        return _in_one_task(icn.select("n"), edges, "n long, r double", kernel)
    dealt = _dealt(icn.select("n", F.lit(1.0 / total).alias("base")), edges)
    now, earlier = cut(dealt.first(), "ranks"), None
    for _ in range(rounds):
        after = cut(dealt.after(now, lambda r, w: (r - init) * w, lambda base, sums: init + sums), "ranks")
        gaps = [dealt.gap(after, old) for old in (now, earlier) if old is not None]
        earlier, now = now, after
        if min(gaps) <= tolerance:
            break
    return dealt.ranks(now)
