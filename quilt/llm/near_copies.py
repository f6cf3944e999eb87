"""SimHash near-dedup as a pipeline stage: copies by exact similarity of five-word shingles, one of each group kept.

Texts are near copies if their sets of five-word shingles have a Jaccard
similarity of 0.8 or more; every link is compared shingle by shingle. SimHash
(see simhash) finds the closest ones: fingerprints of the shingles at most four
bits apart, by the generalised pigeonhole. At a similarity of 0.8 fingerprints
differ in 10 bits of 64 on average and in 17 at worst in a hundred, so wide that
any set of parts and thresholds makes nearly all pairs candidates; there the
method can't give whole results. So each text also has 24 keys of 6 MinHash
values: two texts of similarity 0.8 share a key with a probability of at least
1 - (1 - 0.8^6)^24 = 0.9993, and pairs that share one and aren't linked yet are
compared as well: members of a key with one of them first, which joins most,
then members of different groups with each other. The latter are compared where
they stand, in blocks of a key's members, and only links leave the task.
"""

from __future__ import annotations

import sys
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quilt.llm import common, simhash
from quilt.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 6
#: Pairs whose sketches of 144 values agree in a share lower by this much aren't compared: 4 standard deviations at 0.8, 3 pairs in 100,000.
MARGIN = 0.134
SEED = 42
#: Members of a key that stand together; keys with more are dealt out as pairs of blocks.
BLOCK = 512
#: Bytes of shingles that a comparing worker remembers; no result hangs on it.
REMEMBERED = 64 << 20
_RANDOM = np.random.default_rng(SEED)
_TIMES = (_RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1))[:, None]
_PLUS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)[:, None]


def shingles(data: bytes, size: int = SHINGLE) -> set[bytes]:
    """Shingles of lowered words (A-Z and ASCII white space alone); shorter texts are one shingle, no words none."""
    words = data.lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def similar(a: set, b: set, least: float = SIMILARITY) -> bool:
    """Whether the Jaccard similarity is ``least`` or more; two empty sets are alike."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    common_ones = len(a & b)
    return common_ones >= least * (len(a) + len(b) - common_ones)


def signature(found: set[bytes]) -> tuple[int, np.ndarray, bytes]:
    """SimHash fingerprint of the shingles, BANDS keys of the least values of ROWS permutations each, and a byte of each value."""
    least = np.full(BANDS * ROWS, (1 << 32) - 1, dtype=np.uint32)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), dtype=np.uint64, count=len(found))
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 512):
        some = hashes[at : at + 512]
        counts += simhash.ones(some)
        np.minimum(least, (some.astype(np.uint32) * _TIMES + _PLUS).min(axis=1), out=least)
    data, width = least.tobytes(), 4 * ROWS
    keys = np.array([xxhash.xxh64_intdigest(data[i * width : (i + 1) * width], i) for i in range(BANDS)], dtype=np.uint64)
    return simhash.majority(counts, len(hashes)), keys.view(np.int64), least.astype(np.uint8).tobytes()


def _signatures(batches):
    for batch in batches:
        for part in common.by_bytes(batch, "text"):
            prints, keys, sketches = zip(*(signature(shingles(d.as_py())) for d in part.column("text").cast(pa.binary())))
            flat = pa.array(np.concatenate(keys))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), flat)
            fp = pa.array(np.array(prints, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column("node"), fp, listed, pa.array(sketches, pa.binary())], ["node", "fp", "bands", "sketch"])


def _likely(least: float):
    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, BANDS * ROWS) for c in ("sketch_a", "sketch_b"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= least - MARGIN))

    return run


class _Remembered:
    """Shingles of the texts met last."""

    def __init__(self):
        self.known: OrderedDict[int, tuple[set, int]] = OrderedDict()
        self.held = 0

    def __call__(self, node: int, text: pa.Scalar) -> set:
        if node in self.known:
            self.known.move_to_end(node)
            return self.known[node][0]
        data = text.as_py()
        found = shingles(data)
        size = sys.getsizeof(found) + sum(map(sys.getsizeof, found))
        self.known[node] = found, size
        self.held += size
        while self.held > REMEMBERED and len(self.known) > 1:
            self.held -= self.known.popitem(last=False)[1][1]
        return found


def _joined_in_block(rows: pa.Table, of: _Remembered, least: float) -> list[tuple[int, int]]:
    """Links (a, b) that join a block's groups: at most one a member. side 0 and 1 are compared with each other, or all of side 0 alone."""
    node, label, side = (rows[c].to_numpy().copy() for c in ("node", "label", "side"))
    sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), dtype=np.uint8).reshape(-1, BANDS * ROWS)
    texts = rows["text"].cast(pa.binary())
    first, second = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
    links = []
    for place, i in enumerate(first):
        others = second if len(second) else first[place + 1 :]
        others = others[label[others] != label[i]]
        if not len(others):
            continue
        likely = others[np.count_nonzero(sketch[others] == sketch[i], axis=1) >= (least - MARGIN) * BANDS * ROWS]
        for j in likely:
            if label[j] != label[i] and similar(of(node[i], texts[i]), of(node[j], texts[j]), least):
                links.append((max(node[i], node[j]), min(node[i], node[j])))
                label[label == label[j]] = label[i]
    return links


def _join_blocks(least: float):
    """Rows sorted by (band, key, sub) in, links out."""

    def run(batches):
        of, held = _Remembered(), []

        def links(rows: pa.Table):
            group = np.stack([rows[c].to_numpy().astype(np.int64) for c in ("band", "key", "sub")])
            cuts = [0, *(np.nonzero((group[:, 1:] != group[:, :-1]).any(axis=0))[0] + 1).tolist(), rows.num_rows]
            found = [x for a, b in zip(cuts, cuts[1:]) for x in _joined_in_block(rows.slice(a, b - a), of, least)]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

        for batch in (part for whole in batches for part in common.by_bytes(whole, "text")):
            if held and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in ("band", "key", "sub")):
                yield from links(pa.Table.from_batches(held))
                held = []
            # What follows may go on with the batch's last block, so that one is kept.
            rows = pa.Table.from_batches([*held, batch])
            same = np.ones(rows.num_rows, bool)
            for c in ("band", "key", "sub"):
                same &= rows[c].to_numpy() == rows[c][-1].as_py()
            cut = int(np.argmax(same))
            if cut:
                yield from links(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
        if held:
            yield from links(pa.Table.from_batches(held))

    return run


def _compare(least: float):
    def run(batches):
        of = _Remembered()
        for batch in (part for whole in batches for part in common.by_bytes(whole, "text_a")):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            texts = batch.column("text_a").cast(pa.binary()), batch.column("text_b").cast(pa.binary())
            out = [k for k in range(batch.num_rows) if similar(of(b[k], texts[1][k]), of(a[k], texts[0][k]), least)]
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in out], pa.int64()), pa.array([b[k] for k in out], pa.int64())], ["a", "b"])

    return run


def _verified(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar."""
    pairs = pairs.join(sketches.toDF("a", "sketch_a"), "a").join(sketches.toDF("b", "sketch_b"), "b")
    pairs = common.materialise(pairs.select("a", "b", "sketch_a", "sketch_b").mapInArrow(common.lean(_likely(least)), "a long, b long"), "likely")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    some = common.materialise(texts.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "candidates")
    left = pairs.join(some.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(some.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    found = common.materialise(both.select("a", "b", "text_a", "text_b").mapInArrow(common.lean(_compare(least)), "a long, b long"), "similar")
    common.discard(pairs)
    common.discard(some)
    return found


def _node(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def _close_prints(docs: DataFrame) -> DataFrame:
    """(a, b): texts whose fingerprints SimHash links, each fingerprint by its least node, and those of one fingerprint."""
    prints = common.materialise(docs.groupBy("fp").agg(F.min("node").alias("least")), "prints")
    near = simhash.links(prints.select("fp", F.col("least").alias("node"))).select("a", "b")
    equal = docs.join(prints, "fp").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    found = common.materialise(near.unionByName(equal).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
    common.discard(prints)
    return found


def _open_rows(keys: DataFrame, found: DataFrame) -> DataFrame:
    """(node, band, key, label, n): the rows of keys, n of each, that texts of several groups share; found: (node, component)."""
    label = keys.join(found, "node", "left").select("node", "band", "key", F.coalesce("component", "node").alias("label"))
    mixed = label.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")
    open_keys = common.materialise(mixed.select("band", "key", "n"), "open-keys")
    rows = common.materialise(label.join(open_keys, ["band", "key"]), "open-rows")
    common.discard(open_keys)
    return rows


def _joined(rows: DataFrame, sketches: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b): links between groups that share keys; rows: (node, band, key, label, n)."""
    wanted = common.materialise(rows.select("node").distinct(), "wanted")
    some = common.materialise(texts.join(wanted, "node", "left_semi").dropDuplicates(["node"]).join(sketches, "node"), "candidates")
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    placed = rows.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")))
    # Block pair (i, j) with i <= j is numbered i * blocks + j; block i is side 0 and block j side 1, and i = j holds one block.
    at = F.transform(F.expr("sequence(0L, blocks - 1)"), lambda i: F.struct((F.least(i, "mine") * F.col("blocks") + F.greatest(i, "mine")).alias("sub"), (i < F.col("mine")).cast("int").alias("side")))
    dealt = placed.select("node", "band", "key", "label", F.inline(at)).join(some, "node")
    ordered = dealt.select("node", "band", "key", "label", "sub", "side", "sketch", "text").repartition("band", "key", "sub").sortWithinPartitions("band", "key", "sub")
    links = common.materialise(ordered.mapInArrow(common.lean(_join_blocks(least)), "a long, b long"), "joined")
    common.discard(wanted)
    common.discard(some)
    return links


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(doc_id, node, component) per row of df: the hash of its text and the least one that links of near copies reach."""
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), _node(text_col).alias("node"))
    texts = df.select(_node(text_col).alias("node"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    signed = common.materialise(texts.mapInArrow(common.lean(_signatures), "node long, fp long, bands array<long>, sketch binary"), "signatures")
    docs = common.materialise(signed.dropDuplicates(["node"]), "texts")
    common.discard(signed)
    sketches = docs.select("node", "sketch")
    keys = common.materialise(docs.select("node", F.posexplode("bands").alias("band", "key")), "band-keys")
    tried = _close_prints(docs.select("node", "fp"))
    links = _verified(tried, sketches, texts, least)
    left = _open_rows(keys, components(links))
    # One member of each key, the same for all, against the others.
    head = F.min(F.struct(F.xxhash64("node"), "node", "label"))
    heads = left.groupBy("band", "key").agg(head.alias("head")).select("band", "key", F.col("head.node").alias("other"), F.col("head.label").alias("theirs"))
    pairs = left.join(heads, ["band", "key"]).where("label <> theirs").select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()
    pairs = common.materialise(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
    common.discard(left)
    common.discard(tried)
    links = links.unionByName(_verified(pairs, sketches, texts, least))
    common.discard(pairs)
    left = _open_rows(keys, components(links))
    common.discard(keys)
    links = links.unionByName(_joined(left, sketches, texts, least))
    common.discard(left)
    common.discard(docs)
    found = components(links)
    return rows.join(found, "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("component"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row of df for each group of near copies, the one with the smallest doc_id; columns as they were.

    Of rows with the same smallest id the one whose text has the least hash
    stays; rows equal in id and text are one. Null ids come last, so a group
    keeps a row without an id only if none of its rows has one. Null, empty
    and blank texts are one group.
    """
    found = common.materialise(groups(df, id_col, text_col, least), "near-copies")
    best = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node")).alias("best"))
    heads = best.select(F.col("best.doc_id").alias("__id"), F.col("best.node").alias("__head"))
    marked = df.withColumn("__node", _node(text_col))
    same = lambda other: marked[id_col].eqNullSafe(other["__id"]) & (marked["__node"] == other["__head"])
    repeated = found.groupBy(F.col("doc_id").alias("__id"), F.col("node").alias("__head")).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    if not repeated.head(1):
        return marked.join(heads, same(heads), "left_semi").select(*df.columns)
    repeated = common.materialise(repeated, "repeated-rows")
    kept = marked.join(heads, same(heads), "left_semi")
    again = kept[id_col].eqNullSafe(repeated["__id"]) & (kept["__node"] == repeated["__head"])
    once = kept.join(repeated, again, "left_anti")
    several = kept.join(repeated, again, "left_semi").dropDuplicates([id_col, "__node"])
    return once.unionByName(several).select(*df.columns)
