"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on document ids.

A data set is a folder of ORC files in ascending document order. Each row holds
``doc_id``, ``part`` (the number of its range, ascending with doc_id),
``part_start`` (ids before the document within its part) and ``ids``. ORC
encodes the integer columns as runs, keeps minima and maxima per stripe and row
group, and a Bloom filter of doc_id, so a reader that asks for some documents
skips the other stripes, and stripes are read in parallel.
"""

from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quilt.llm import common
from quilt.llm.pieces import worker_pieces

END_ID = 2
STRIPE_BYTES = 64 << 20
ROW_GROUP = 10_000
#: Bytes of text in a range, and ranges for each core at least.
RANGE_BYTES, RANGES_A_CORE = 128 << 20, 4
#: Bytes of text encoded at once; fewer take less of a worker's memory and more time, ids don't depend on it.
BATCH_BYTES = 8 << 20


def _schema(df: DataFrame, id_col: str) -> str:
    return f"doc_id {df.select(f'`{id_col}`').schema[0].dataType.simpleString()}, part int, part_start long, n_tokens long, ids array<int>"


def write(df: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, range_bytes: int = RANGE_BYTES, batch_bytes: int = BATCH_BYTES) -> str:
    """Encode every row's whole text, append end_id and write ORC files under path; returns the files' schema.

    Texts are dealt by ranges of doc_id, as many as make range_bytes of text
    each, or a few for every core where that is more. Rows of one id stand in
    the order of a hash of their texts and then of their place in the input,
    so an id that holds many rows, equal ones even, is spread over ranges. A
    null id comes first, a null text is an empty one (just the end id),
    repeated rows are all written, an empty table gives an empty data set,
    other columns are ignored. doc_id is of any type that sorts.
    """
    schema = _schema(df, id_col)

    def encode(batches):
        pieces = worker_pieces(tokenizer, False)
        part, start = TaskContext.get().partitionId(), 0  # ranges are numbered in order
        for batch in batches:
            for rows in common.by_bytes(batch, "text", batch_bytes):
                values, n = pieces.encoded(rows.column("text"))
                values, n = np.insert(values.view("<i4"), np.cumsum(n), end_id), n + 1
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values))
                before = start + ends - n
                start += int(ends[-1])
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(before, pa.int64()), pa.array(n), lists], ["doc_id", "part", "part_start", "n_tokens", "ids"])

    rows = common.picked(df, doc_id=id_col, text=text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(-(-size // range_bytes), RANGES_A_CORE * df.sparkSession.sparkContext.defaultParallelism)
    order = ["doc_id", F.xxhash64("text"), F.monotonically_increasing_id()]
    keyed = rows.select("doc_id", "text", *[c.alias(f"o{i}") for i, c in enumerate(order[1:])])
    ordered = keyed.repartitionByRange(ranges, "doc_id", "o0", "o1").sortWithinPartitions("doc_id", "o0", "o1").select("doc_id", "text")
    writer = ordered.mapInArrow(encode, schema).write.option("compression", "zstd")
    writer.option("orc.bloom.filter.columns", "doc_id").option("orc.stripe.size", str(STRIPE_BYTES)).option("orc.row.index.stride", str(ROW_GROUP)).orc(path)
    return schema


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a data set; filters on doc_id reach the stripes' statistics and Bloom filters."""
    return spark.read.schema(schema).orc(path)


def digests(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per document, from the files' ids.

    start counts the ids of all documents before it: one sum per part (as many
    as tasks wrote, not as documents) comes to the driver and is summed up in
    order of the parts.
    """
    sums = {r["part"]: r["n"] for r in read(spark, path, schema).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    order = sorted(sums)
    base = dict(zip(order, accumulate([0, *(sums[p] for p in order)])))
    id_type = schema.split(",")[0]

    def digest(batches):
        for batch in batches:
            lists = batch.column("ids")
            bounds = lists.offsets.to_numpy().tolist()
            data = memoryview(np.ascontiguousarray(lists.values.to_numpy(), dtype="<u4")).cast("B")
            parts = batch.column("part").to_numpy()
            starts = batch.column("part_start").to_numpy() + np.array([base[p] for p in parts.tolist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(starts), pa.array([b - a for a, b in zip(bounds, bounds[1:])], pa.int64()), pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(bounds, bounds[1:])], pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return read(spark, path, schema).select("doc_id", "part", "part_start", "ids").mapInArrow(digest, f"{id_type}, start long, n_tokens long, ids_crc32 long")
