"""SimHash near-duplicates by the generalised pigeonhole principle.

Bits that go together in a sample are grouped into parts; a dynamic program
gives each part its own threshold so that the thresholds add up to what the
principle asks for (the distance less the number of parts, plus one) and the
estimated work is least. Two fingerprints within the distance then agree on
some part within its threshold (-1: the part isn't looked at). Each fingerprint
is indexed under its part's bits and probes the keys within the threshold; the
members of a key are verified on all bits.
"""

from __future__ import annotations

from functools import partial
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quilt.llm import common
from quilt.llm.components import components

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: Fingerprints sampled (least hashes first) to group bits and estimate work; a bound on the sample alone.
SAMPLE = 4096
#: Members of a key that one task compares with each other; fuller keys are dealt out in blocks of pairs.
BLOCK = 4096
#: Work of one written row in terms of one comparison.
ROW_COST = 40
#: Node numbers from here on stand for fingerprints of documents without an id.
NO_ID = (1 << 63) - (1 << 60)


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """A bit is set where over half of the shingles' XXH64 have it; no words: zero."""
    words = data.lower().split()  # of bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    n = len(words) - shingle + 1
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 15):
        to = min(n, at + (1 << 15))
        counts += ones(np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts[at:to], starts[at + shingle : to + shingle])], dtype="<u8"))
    return majority(counts, n)


def ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    return np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    """The bits that over half of n hashes have."""
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            for part in common.by_bytes(batch, "text"):
                found = [fingerprint(d or b"", shingle) for d in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], ["doc_id", "fp"])

    return common.picked(df, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id long, fp long")


def _grouped(bits: np.ndarray, m: int) -> list[list[int]]:
    """64 bit positions in m groups of correlated bits; bits: sampled fingerprints, one column per bit."""
    centred = bits - bits.mean(axis=0)
    spread = np.sqrt((centred**2).sum(axis=0))
    spread[spread == 0] = 1
    close = np.abs(centred.T @ centred) / np.outer(spread, spread)
    np.fill_diagonal(close, 0)
    left, groups = set(range(64)), []
    for g in range(m):
        width = len(left) // (m - g)
        seed = max(left, key=lambda b: (close[b, sorted(left)].sum(), -b))
        group = [seed]
        left.discard(seed)
        while len(group) < width:
            best = max(left, key=lambda b: (close[b, group].sum(), -b))
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def plan(sample: np.ndarray, n: int, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(mask, threshold) of the parts that are looked at, for n fingerprints of which sample (uint64) are some."""
    if len(sample) < 2:
        return [((1 << 64) - 1, distance)] if distance == 0 else [(sum(1 << b for b in range(i, 64, distance + 1)), 0) for i in range(distance + 1)]
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    some = sample[:1024]
    apart = some[:, None] ^ some[None, :]
    scale = n * (n - 1) / (len(some) * (len(some) - 1))
    best: tuple = (float("inf"), [])
    for m in range(2, distance + 2):
        groups = _grouped(bits, m)
        masks = [sum(1 << b for b in g) for g in groups]
        need = distance - m + 1
        costs = []
        for mask, g in zip(masks, groups):
            near = np.bincount(np.bitwise_count(apart & np.uint64(mask)).ravel(), minlength=need + 2)
            near[0] -= len(some)
            pairs = np.cumsum(near)[: need + 1] / 2 * scale
            rows = np.cumsum([comb(len(g), e) / (2 if e else 1) for e in range(need + 1)]) * n
            costs.append([0.0, *(pairs + ROW_COST * rows)])  # threshold -1 first
        # total[t]: least cost of the parts so far whose thresholds (counted from -1) sum to t.
        total: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for part_costs in costs:
            nxt: dict[int, tuple[float, list[int]]] = {}
            for t, (cost, chosen) in total.items():
                for e, c in enumerate(part_costs):
                    if t + e <= need + m and (t + e not in nxt or cost + c < nxt[t + e][0]):
                        nxt[t + e] = (cost + c, [*chosen, e - 1])
            total = nxt
        cost, chosen = total.get(need + m, (float("inf"), []))
        if cost < best[0]:
            best = (cost, [(mask, e) for mask, e in zip(masks, chosen) if e >= 0])
    return best[1]


def _probe_masks(mask: int, threshold: int) -> list[tuple[int, int]]:
    """(flip, top): the sets of up to ``threshold`` bits of mask to flip, and the highest of them."""
    bits = [b for b in range(64) if mask >> b & 1]
    return [(sum(1 << b for b in chosen), 1 << chosen[-1]) for e in range(1, threshold + 1) for chosen in combinations(bits, e)]


def _keys(parts: list[tuple[int, int]]):
    """Rows (part, key, probe, fp, node): each fingerprint's index row and probes for every part.

    Of two fingerprints that differ in a part, only the one that has the
    highest differing bit probes for the other, so each pair meets once.
    """
    probes = [_probe_masks(mask, e) for mask, e in parts]

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                fp = batch.column("fp").to_numpy().view(np.uint64)
                node = batch.column("node").to_numpy()
                for k, (mask, _) in enumerate(parts):
                    own = fp & np.uint64(mask)
                    out = [(own, np.zeros(len(fp), np.int8), fp, node)]
                    for flip, top in probes[k]:
                        has = (fp & np.uint64(top)) != 0
                        out.append((own[has] ^ np.uint64(flip), np.ones(int(has.sum()), np.int8), fp[has], node[has]))
                    key, probe, f, n = (np.concatenate(c) for c in zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(key), k, np.int8)), pa.array(key.view(np.int64)), pa.array(probe), pa.array(f.view(np.int64)), pa.array(n)],
                        ["part", "key", "probe", "fp", "node"],
                    )

    return run


def _near(x: np.ndarray, y: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= distance


def _forest(fp: np.ndarray, node: np.ndarray, side: np.ndarray, distance: int) -> list[tuple]:
    """Links that join what the members of one key hold together; sides: 0/1 blocks of index rows, 2 probes.

    A spanning forest: at most one link for each member, however many pairs are close.
    """
    label = np.arange(len(fp))
    links = []
    both = (side == 1).any()
    for i in np.nonzero(side != 1)[0]:
        if side[i] == 2:
            others = np.nonzero(side == 0)[0]
        elif both:
            others = np.nonzero(side == 1)[0]
        else:
            others = np.nonzero((side == 0) & (np.arange(len(fp)) > i))[0]
        close = others[_near(fp[others], fp[i], distance)]
        for root in np.unique(label[close]):
            if root != label[i]:
                links.append((node[i], node[close[label[close] == root][0]]))
                label[label == root] = label[i]
    return links


def _verify(distance: int, batches):
    """Rows sorted by (part, key, sub, side) in; links between nodes within the distance out."""

    def links(rows: pa.Table):
        fp = rows["fp"].to_numpy().view(np.uint64)
        node, side = rows["node"].to_numpy(), rows["side"].to_numpy()
        group = np.stack([rows[c].to_numpy().astype(np.int64) for c in ("part", "key", "sub")])
        fresh = np.ones(len(fp), bool)
        fresh[1:] = (group[:, 1:] != group[:, :-1]).any(axis=0)
        number = np.cumsum(fresh) - 1
        sizes = np.bincount(number)
        crossed = np.bincount(number, weights=side == 1) > 0
        small = ((sizes <= 8) & ~crossed)[number]
        out_a, out_b = [], []
        for step in range(1, 8):
            if len(fp) <= step:
                break
            # Index rows come first in a key; two probes of a key are no pair.
            pair = (number[step:] == number[:-step]) & small[step:] & (side[:-step] == 0)
            at = np.nonzero(pair)[0]
            if not len(at):
                break
            at = at[_near(fp[at], fp[at + step], distance)]
            out_a.append(node[at])
            out_b.append(node[at + step])
        starts = np.nonzero(fresh)[0]
        for g in np.nonzero((sizes > 8) | crossed)[0]:
            s = slice(starts[g], starts[g] + sizes[g])
            found = _forest(fp[s], node[s], side[s], distance)
            if found:
                a, b = zip(*found)
                out_a.append(np.array(a))
                out_b.append(np.array(b))
        if out_a:
            a, b = np.concatenate(out_a), np.concatenate(out_b)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < 1 << 17:
            continue
        rows = pa.Table.from_batches(held)
        last = [rows[c][-1].as_py() for c in ("part", "key", "sub")]
        same = np.ones(rows.num_rows, bool)
        for c, v in zip(("part", "key", "sub"), last):
            same &= rows[c].to_numpy() == v
        cut = int(np.argmax(same))  # rows of one key stand together
        yield from links(rows.slice(0, cut)) if cut else ()
        held = rows.slice(cut).to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        if rows.num_rows:
            yield from links(rows)


def links(prints: DataFrame, distance: int = DISTANCE, block: int = BLOCK, sample_size: int = SAMPLE) -> DataFrame:
    """(a, b): links between nodes whose fingerprints (fp, node; one row each) differ in at most distance bits.

    Not every close pair is written, but every two that are close end up
    connected. Keys that more than ``block`` fingerprints are indexed under
    are dealt out as pairs of blocks, so no task meets one whole.
    """
    n = prints.count()
    sample = prints.orderBy(F.xxhash64("fp"), "fp").limit(sample_size).select("fp").collect()
    parts = plan(np.array([r["fp"] for r in sample], dtype=np.int64).view(np.uint64), n, distance)
    rows = prints.mapInArrow(_keys(parts), "part byte, key long, probe byte, fp long, node long")
    own = [prints.select(F.lit(k).cast("byte").alias("part"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("key")) for k, (mask, _) in enumerate(parts)]
    counted = own[0]
    for more in own[1:]:
        counted = counted.unionByName(more)
    full = counted.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > block).select(F.col("part").alias("p"), F.col("key").alias("k"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    full = common.materialise(full, "full-keys")
    joined = rows.join(full, (F.col("part") == F.col("p")) & (F.col("key") == F.col("k")), "left") if full.head(1) else rows.withColumn("blocks", F.lit(None).cast("int"))
    # In block pair (i, j), numbered i * blocks + j, block i is side 0 and block j side 1; i = j holds one block, against which probes go.
    spread = joined.withColumn("mine", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")).withColumn(
        "at",
        F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("sub"), F.when(F.col("probe") == 1, 2).otherwise(0).alias("side"))))
        .when(F.col("probe") == 1, F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct((i * F.col("blocks") + i).alias("sub"), F.lit(2).alias("side"))))
        .otherwise(
            F.transform(
                F.sequence(F.lit(0), F.col("blocks") - 1),
                lambda i: F.struct(
                    F.when(i < F.col("mine"), i * F.col("blocks") + F.col("mine")).otherwise(F.col("mine") * F.col("blocks") + i).alias("sub"),
                    F.when(i < F.col("mine"), 1).otherwise(0).alias("side"),
                ),
            )
        ),
    )
    dealt = spread.select("part", "key", F.inline("at"), "fp", "node") if full.head(1) else rows.selectExpr("part", "key", "0 AS sub", "CASE WHEN probe = 1 THEN 2 ELSE 0 END AS side", "fp", "node")
    ordered = dealt.repartition("part", "key", "sub").sortWithinPartitions("part", "key", "sub", "side")
    return ordered.mapInArrow(partial(_verify, distance), "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id per row of df.

    component_id is the smallest doc_id that links of at most ``distance``
    bits reach, itself included. doc_id is a whole number below NO_ID. Rows
    with equal fingerprints are one node of the search, so copies cost
    nothing there. Null and empty texts have fingerprint zero and link like
    any other; a null doc_id stays null and never is a component_id, unless
    the whole component has none (then null). Repeated rows are each
    returned, an empty table gives an empty result, other columns are ignored.
    """
    docs = common.materialise(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    unnamed = F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("fp"), 4)
    prints = common.materialise(docs.groupBy("fp").agg(F.min("doc_id").alias("node")).select("fp", F.coalesce("node", unnamed).alias("node")), "prints")
    found = components(links(prints, distance))
    named = prints.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    named = named.select("fp", F.when(F.col("component") < NO_ID, F.col("component")).alias("component_id"))
    return docs.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
