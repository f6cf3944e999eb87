"""Token counts: lengths only, by batch encoding in Arrow functions."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quilt.llm import common
from quilt.llm.pieces import worker_pieces

LIMIT = 512


def token_counts(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every row's whole text.

    Batches are balanced by bytes, long texts are cut where no token can cross
    (see pieces), and only lengths leave the worker. tokenizer: path of a
    byte-level vocabulary file. A null text counts as empty (0 bytes, 0
    tokens); a null id stays null; repeated rows are each counted; an empty
    table gives an empty result; other columns are ignored.
    """
    types = df.select(f"`{id_col}`").schema[0].dataType

    def count(batches):
        pieces = worker_pieces(tokenizer, True)
        for batch in batches:
            for part in common.by_bytes(batch, "text"):
                texts = part.column("text")
                _, n = pieces.encoded(texts)
                size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), size, pa.array(n), pa.array(n > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    schema = f"doc_id {types.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    return common.picked(df, doc_id=id_col, text=text_col).mapInArrow(count, schema)
