"""Benchmark decontamination by Wu-Manber search over words.

Test strings are windows of words. For each window length a table gives, for
every block of two words, how far the search may skip; a block that ends some
window skips nothing and names a bucket, in which windows with the text's hash
are picked and compared byte by byte. Tables are sorted arrays, some 40 bytes a
window, so their size is known before they are built.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_type

from quilt.llm import common

WINDOW = 8
MIN_ITEMS = 2
#: Bytes of one broadcast table, by WORD_BYTES a word and the text; larger benchmarks go over the documents block by block.
TABLE_BYTES, WORD_BYTES = 128 << 20, 48

#: ASCII letters lowered, other ASCII but digits to spaces; bytes of other characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | bytes | None) -> list[bytes]:
    data = text.encode() if isinstance(text, str) else text or b""
    return data.translate(_FOLD).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> set[tuple]:
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def _hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words), dtype=np.uint64, count=len(words))


def _mixed(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that end at each place from the n-th on."""
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - n + 1 + k]
    return out


class WuManber:
    """Skip tables and buckets for the windows of items (id, text)."""

    def __init__(self, items: list[tuple], size: int = WINDOW):
        self.ids = [number for number, _ in items]
        by_length: dict[int, list] = {}
        for k, (_, text) in enumerate(items):
            words = words_of(text)
            if words:
                by_length.setdefault(min(size, len(words)), []).append((k, words))
        self.tables = [self._table(n, found) for n, found in sorted(by_length.items())]

    @staticmethod
    def _table(n: int, found: list[tuple[int, list[bytes]]]) -> tuple:
        block = min(2, n)
        keys, shifts, suffix, whole, owner, start, end = ([] for _ in range(7))
        blob, at = [], 0
        for k, words in found:
            hashes, places = _hashes(words), np.cumsum([0, *(len(w) + 1 for w in words)]) + at
            keys.append(_mixed(hashes, block))
            # Windows begin at each word, so a block that ends at word j is best placed in the window that begins with the item.
            shifts.append(np.maximum(0, n - 1 - np.arange(block - 1, len(words))).astype(np.uint8))
            whole.append(_mixed(hashes, n))
            suffix.append(keys[-1][n - block :])
            owner.append(np.full(len(whole[-1]), k, np.int32))
            start.append(places[: len(whole[-1])])
            end.append(places[n:] - 1)
            blob.append(b" ".join(words) + b" ")
            at = int(places[-1])
        key, shift = np.concatenate(keys), np.concatenate(shifts)
        order = np.lexsort((shift, key))
        key, first = np.unique(key[order], return_index=True)
        tail, full = np.concatenate(suffix), np.concatenate(whole)
        place = np.lexsort((full, tail))
        columns = [np.concatenate(c)[place] for c in (owner, start, end)]
        return n, block, key, shift[order][first], tail[place], full[place], *columns, b"".join(blob)

    def search(self, words: list[bytes]) -> tuple[list[list[int]], set]:
        """Merged word spans [start, end) inside occurrences, and the ids of items that occur."""
        spans, items = [], set()
        hashes = _hashes(words) if self.tables else None
        for n, block, key, shift, tail, full, owner, start, end, blob in self.tables:
            if len(words) < n:
                continue
            blocks = _mixed(hashes, block)
            at = np.minimum(np.searchsorted(key, blocks), len(key) - 1)
            skips = np.where(key[at] == blocks, shift[at], n - block + 1).tolist()
            i, last = n - block, len(skips)
            while i < last:
                skip = skips[i]
                if skip:
                    i += skip
                    continue
                first = i - (n - block)  # the window's first word
                own = _mixed(hashes[first : first + n], n)[0]
                lo, hi = np.searchsorted(tail, blocks[i], "left"), np.searchsorted(tail, blocks[i], "right")
                lo, hi = lo + np.searchsorted(full[lo:hi], own, "left"), lo + np.searchsorted(full[lo:hi], own, "right")
                if lo < hi:
                    text = b" ".join(words[first : first + n])
                    hits = [w for w in range(lo, hi) if blob[start[w] : end[w]] == text]  # equal bytes, not only hashes
                    if hits:
                        spans.append([first, first + n])
                        items.update(self.ids[owner[w]] for w in hits)
                i += 1
        return merged(spans), items


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int):
    """Items in blocks whose tables take at most ``limit`` bytes (one larger item is a block), row by row from the executors."""
    held, size = [], 0
    for r in common.picked(benchmark, item=item_col, text=text_col).toLocalIterator():
        n = len((r["text"] or "").encode()) + WORD_BYTES * len(words_of(r["text"]))
        if held and size + n > limit:
            yield held
            held, size = [], 0
        held.append((r["item"], r["text"]))
        size += n
    if held:
        yield held


def search(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", table_bytes: int = TABLE_BYTES, carry: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, spans (word offsets inside occurrences), items (ids with an occurring window).

    carry keeps all columns of df (its names must then differ from the
    results'). Ids are of any type. Null texts have no words; items without
    words match nothing and items with a null id mark words but aren't listed;
    repeated rows are each searched; empty tables give empty results, or
    documents without hits. A benchmark whose table would outgrow table_bytes
    is searched block after block, the rows so far written to the shared
    folder in between.
    """
    spark = df.sparkSession
    state = df.withColumn("__text", F.col(f"`{text_col}`")) if carry else common.picked(df, doc_id=id_col, __text=text_col)
    item_type = benchmark.select(f"`{item_col}`").schema[0].dataType
    item_arrow, own = to_arrow_type(item_type), state.columns[:-1]
    found = [S.StructField("n_words", S.LongType()), S.StructField("n_hit", S.LongType()), S.StructField("spans", S.ArrayType(S.ArrayType(S.IntegerType()))), S.StructField("items", S.ArrayType(item_type))]
    schema = S.StructType([*state.schema.fields, *found])
    blocks = _blocks(benchmark, item_col, item_text, table_bytes)
    block, first = next(blocks, []), True
    while block is not None:
        following = next(blocks, None)
        table = spark.sparkContext.broadcast(WuManber(block))

        def run(batches, table=table, first=first):
            tables = table.value
            for batch in batches:
                for part in common.by_bytes(batch, "__text"):
                    n_words, n_hit, all_spans, all_items = [], [], [], []
                    before = None if first else (part.column("spans").to_pylist(), part.column("items").to_pylist())
                    for k, data in enumerate(part.column("__text").cast(pa.binary()).to_pylist()):
                        words = words_of(data)
                        spans, items = tables.search(words)
                        if before:
                            spans, items = merged(spans + before[0][k]), items | set(before[1][k])
                        n_words.append(len(words))
                        n_hit.append(sum(b - a for a, b in spans))
                        all_spans.append(spans)
                        all_items.append(sorted(x for x in items if x is not None))
                    kept = [part.column(c) for c in [*own, "__text"]]
                    yield pa.RecordBatch.from_arrays(
                        [*kept, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(all_spans, pa.list_(pa.list_(pa.int32()))), pa.array(all_items, pa.list_(item_arrow))],
                        [*own, "__text", "n_words", "n_hit", "spans", "items"],
                    )

        state = state.mapInArrow(run, schema)
        if following is not None:
            state = common.materialise(state, "decontam")
        block, first = following, False
    return state.drop("__text")


def clean_documents(df: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df in which no window of any benchmark item occurs, items without an id included; columns as they were, whatever their names."""
    names = [f"c{i}" for i in range(len(df.columns))]
    found = search(df.toDF(*names), benchmark, text_col=names[df.columns.index(text_col)], carry=True)
    return found.where("n_hit = 0").select(*names).toDF(*df.columns)


#: DuckDB SQL for the query's rows.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(list_slice(w, i, i + 7), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 6, 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT rid, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
marks AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY rid)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN marks USING (rid) LEFT JOIN items USING (rid)
"""
