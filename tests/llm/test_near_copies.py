"""The near-dedup stage against all pairs, and its recall on planted near copies."""

import random
import sys

import pyarrow as pa
from pyspark import cloudpickle

import corpus_pipeline
from quilt.llm import catalogue, common, near_copies, pieces, quality

SF = "/root/testdata/sf0.001"


def plain_heads(texts):
    """Smallest ids of the groups that pairs of similarity 0.8 on five-word shingles link."""
    sets = {}
    for i, t in texts.items():
        words = t.lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    close = {i: [j for j in sets if sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])] for i in sets}
    label, again = {i: i for i in sets}, True
    while again:
        again = False
        for i in sets:
            least = min(label[j] for j in close[i])
            again |= least < label[i]
            label[i] = least
    return {i for i in label if label[i] == i}


def test_stage_against_all_pairs(spark):
    docs = common.materialise(quality.kept_documents(common.table(spark, SF, "documents")), "test")
    got = corpus_pipeline.near_dedup(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(plain_heads({r.doc_id: r.text for r in docs.collect()}))


def test_recall_of_planted_copies(spark):
    """Copies with a few words changed, of similarity 0.8 to 1, go; those below 0.8 stay, in crowded groups as well."""
    rng = random.Random(8)
    texts = {}
    for n in range(80):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        texts[10 * n] = " ".join(words)
        for k in range(1, 8 if n else 10):
            other = list(words)
            for at in rng.sample(range(200), k):
                other[at] = "changed"
            texts[10 * n + k] = " ".join(other)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    want = plain_heads(texts)
    assert want <= kept and len(kept - want) <= 0.01 * (len(texts) - len(want))


def test_remembered_shingles_stay_within_their_bytes(monkeypatch):
    """What a comparing worker remembers is counted as Python holds it, not by the length of its texts."""
    monkeypatch.setattr(near_copies, "REMEMBERED", 1 << 20)
    of, rng = near_copies._Remembered(), random.Random(3)
    for node in range(100):
        of(node, pa.scalar(" ".join(f"w{rng.randrange(10**6)}" for _ in range(300)).encode()))
    held = sum(sys.getsizeof(s) + sum(map(sys.getsizeof, s)) for s, _ in of.known.values())
    assert 1 < len(of.known) < 100 and held <= 1 << 20


def test_workers_of_the_stage_let_go_of_a_tokenizer():
    """A worker that kept a tokenizer drops it when this stage works in it; functions reach workers pickled."""
    pieces.worker_pieces(catalogue.tokenizer_path(), False)
    kept = pieces.worker_pieces(catalogue.tokenizer_path(), True)
    assert list(common._kept.values()) == [kept]
    run = cloudpickle.loads(cloudpickle.dumps(common.lean(near_copies._likely(0.8))))
    assert list(run(iter([]))) == [] and not common._kept
