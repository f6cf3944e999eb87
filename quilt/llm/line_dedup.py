"""Repeated line runs, by a suffix array over line ids.

Texts are sequences of line ids. Suffixes are ranked by distributed prefix
doubling: ranks by 1, 2, 4, ... lines, each round one sort of the distinct
rank pairs (rank of the first half, rank of the second). Suffixes that share
their first m lines form an interval of the array; two ranks of the power of
two below m name it. A run is repeated if its interval holds an earlier start.

Runs count from ``min_words`` words on. It is enough to look at the runs that
are least from some start or to some end on: any longer repeated run is the
union of such runs inside it, and each of them has the same earlier copy.
Lines that occur once can't be in a repeated run, so only stretches of lines
that occur twice or more, with words enough, are ranked at all.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quilt.llm import common

MIN_WORDS = 50
#: Of the second half of a line's hash.
LINE_SEED = 7
#: Stands for a null id in the order of documents: the last.
NO_ID = (1 << 63) - 1
#: Sorts before every rank: the end of a stretch.
END = -(1 << 63)
#: A key with more than this share of all rows is hot, so that fewer than its inverse are.
HOT = 1 / 1024


def _with_key(rows: DataFrame, keys: DataFrame, on: list[str], total: int) -> DataFrame:
    """Rows joined (inner) with keys, which has a row for each key and n, at least the key's rows; total: rows at most.

    Fewer than 1024 keys can be hot; these are broadcast, and their rows are dealt by a hash of the whole row in place
    of the key's last column, a long. Should one meet a key by chance, what was broadcast counts.
    """
    value = F.struct(*[c for c in keys.columns if c not in on])
    is_hot = F.col("n") > total * HOT
    hot = keys.where(is_hot).select(*on, value.alias("by_hot"))
    rest = keys.where(~is_hot).select(*on[:-1], F.col(on[-1]).alias("dealt"), value.alias("by_key"))
    dealt = F.when(F.col("by_hot").isNotNull(), F.xxhash64(*rows.columns)).otherwise(F.col(on[-1]))
    found = rows.join(F.broadcast(hot), on, "left").withColumn("dealt", dealt).join(rest, [*on[:-1], "dealt"], "left")
    return found.withColumn("by", F.coalesce("by_hot", "by_key")).where("by IS NOT NULL").select(*rows.columns, "by.*")


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, h, text): rows of equal id and text are one document."""
    rows = common.picked(df, d=id_col, text=text_col)
    return rows.select(F.coalesce(F.col("d").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))


def _least_windows(min_words: int, batches):
    """(d, h, start, m) of the least runs of min_words words from each start and to each end of a stretch."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for d, h, first, words in zip(*(batch.column(c).to_pylist() for c in ("d", "h", "first", "words"))):
            total = np.concatenate([[0], np.cumsum(words)])
            n = len(words)
            ends = np.searchsorted(total, total[:-1] + min_words)  # of [s, e): least e
            starts = np.searchsorted(total, total[1:] - min_words, side="right") - 1  # greatest s
            found = {(s, int(e)) for s, e in enumerate(ends) if e <= n}
            found |= {(int(s), e + 1) for e, s in enumerate(starts) if s >= 0}
            for s, e in found:
                for column, v in zip(out, (d, h, first + s, e - s)):
                    column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], ["d", "h", "start", "m"])


def _ranked(stretches: DataFrame, longest: int) -> DataFrame:
    """(d, h, pos, rs): rs[t] is the rank of the suffix at pos by its first 2^t lines, for 2^t <= longest."""
    now = stretches.select("d", "h", "g", "pos", F.col("id").alias("r"), F.array("id").alias("rs"))
    total, k = stretches.count(), 1
    while 2 * k <= longest:
        along = Window.partitionBy("d", "h", "g").orderBy("pos")
        pairs = now.withColumn("r2", F.coalesce(F.lead("r", k).over(along), F.lit(END)))
        # Each distinct pair once, in order over all partitions; the numbers ascend and are written before use.
        ranks = common.materialise(pairs.groupBy("r", "r2").agg(F.count("*").alias("n")).orderBy("r", "r2").select("r", "r2", "n", F.monotonically_increasing_id().alias("rank")), "ranks")
        now = common.materialise(_with_key(pairs, ranks, ["r", "r2"], total).select("d", "h", "g", "pos", F.col("rank").alias("r"), F.concat("rs", F.array("rank")).alias("rs")), "suffixes")
        k *= 2
    return now.select("d", "h", "pos", "rs")


def repeated_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(d, h, start, m): runs of m lines from line start on that occur earlier, by document id and line."""
    split = F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    lines = _keyed(df, id_col, text_col).select("d", "h", split).select("d", "h", "pos", F.xxhash64(F.lit(LINE_SEED), "line").alias("id2"), F.xxhash64("line").alias("id1"), F.regexp_count("line", F.lit(common.WORD)).alias("w"))
    lines = common.materialise(lines, "lines")
    # Lines are told apart by 128 bits; those that occur again get numbers of their own, so nothing after this rests on hashes of lines.
    again = lines.groupBy("id2", "id1").agg(F.count("*").alias("n")).where("n > 1")
    again = common.materialise(again.withColumn("id", F.monotonically_increasing_id()), "repeated-lines")
    shared = _with_key(lines, again, ["id2", "id1"], lines.count()).drop("n", "id1", "id2").dropDuplicates(["d", "h", "pos"])
    order = Window.partitionBy("d", "h").orderBy("pos")
    stretches = shared.withColumn("g", F.col("pos") - F.row_number().over(order)).withColumn("total", F.sum("w").over(Window.partitionBy("d", "h", "g")))
    stretches = common.materialise(stretches.where(F.col("total") >= min_words).drop("total"), "stretches")
    whole = stretches.groupBy("d", "h", "g").agg(F.min("pos").alias("first"), F.sort_array(F.collect_list(F.struct("pos", "w"))).alias("lines"))
    windows = whole.select("d", "h", "first", F.transform("lines", lambda x: x["w"]).alias("words")).mapInArrow(partial(_least_windows, min_words), "d long, h long, start int, m int")
    windows = common.materialise(windows, "windows")
    longest = windows.agg(F.max("m")).first()[0] or 0
    ranks = _ranked(stretches, longest)
    level = F.floor(F.log2(F.col("m") + 0.5)).cast("int")
    one = ranks.select("d", "h", F.col("pos").alias("start"), F.col("rs").alias("rs1"))
    two = ranks.select("d", "h", F.col("pos").alias("second"), F.col("rs").alias("rs2"))
    named = windows.withColumn("t", level).withColumn("second", F.col("start") + F.col("m") - F.expr("shiftleft(1, t)"))
    named = named.join(one, ["d", "h", "start"]).join(two, ["d", "h", "second"])
    named = named.select("d", "h", "start", "m", F.element_at("rs1", F.col("t") + 1).alias("a"), F.element_at("rs2", F.col("t") + 1).alias("b"))
    named = common.materialise(named, "named")
    at = F.struct("d", "h", "start")
    firsts = named.groupBy("m", "a", "b").agg(F.min(at).alias("least"), F.count("*").alias("n")).where("n > 1")
    return _with_key(named, firsts, ["m", "a", "b"], named.count()).where(at > F.col("least")).select("d", "h", "start", "m")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_deleted, text (what is left, lines joined by line feeds) per row of df.

    Of the runs of lines with at least min_words words that occur more than
    once, the first in order of doc_id and line stays and later ones are
    deleted, inside a document as well. Lines are equal if all their
    characters are. A null text is an empty one (a single empty line), a null
    doc_id comes last in order, rows equal in id and text are one document and
    get the same result, an empty table gives an empty one, other columns are
    ignored. doc_id is a whole number.
    """
    runs = repeated_runs(df, id_col, text_col, min_words)
    gone = runs.groupBy("d", "h").agg(F.collect_set(F.struct("start", "m")).alias("runs"))
    docs = _keyed(df, id_col, text_col).join(gone, ["d", "h"], "left").select("d", "text", "runs")

    def clean(batches):
        for batch in batches:
            for part in common.by_bytes(batch, "text"):
                n_lines, n_deleted, left = [], [], []
                for text, found in zip(part.column("text").to_pylist(), part.column("runs").to_pylist()):
                    lines = text.split("\n")
                    if found:
                        edge = np.zeros(len(lines) + 1, dtype=np.int64)
                        for x in found:
                            edge[x["start"]] += 1
                            edge[x["start"] + x["m"]] -= 1
                        stays = np.cumsum(edge)[:-1] == 0
                        kept = [line for line, s in zip(lines, stays) if s]
                    else:
                        kept = lines
                    n_lines.append(len(lines))
                    n_deleted.append(len(lines) - len(kept))
                    left.append("\n".join(kept))
                yield pa.RecordBatch.from_arrays([part.column("d"), pa.array(n_lines, pa.int64()), pa.array(n_deleted, pa.int64()), pa.array(left, pa.string())], ["doc_id", "n_lines", "n_deleted", "text"])

    cleaned = docs.mapInArrow(clean, "doc_id long, n_lines long, n_deleted long, text string")
    return cleaned.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


#: DuckDB SQL for the query's rows (ids that occur once).
ORACLE = rf"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM t),
c AS (SELECT doc_id, pos, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
  sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) OVER (PARTITION BY doc_id ORDER BY pos) AS total FROM l),
pairs AS (SELECT a.doc_id, a.pos AS s, b.pos AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.total - a.total + a.n >= {MIN_WORDS}),
win AS (SELECT doc_id, s, min(e) AS e FROM pairs GROUP BY doc_id, s UNION SELECT doc_id, max(s), e FROM pairs GROUP BY doc_id, e),
named AS (SELECT win.doc_id, s, e, array_to_string(list_slice(lines, s, e), chr(10)) AS k FROM win JOIN t ON t.doc_id = win.doc_id),
ranked AS (SELECT doc_id, s, e, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM named),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS pos FROM ranked WHERE n > 1),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(gone.pos) AS n_deleted, string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE gone.pos IS NULL) AS text
  FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.pos = l.pos GROUP BY l.doc_id)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_deleted AS BIGINT) AS n_deleted, md5(coalesce(text, '')) AS text_md5 FROM kept
"""
