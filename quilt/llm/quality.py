"""Quality rules, lines first: failing lines go, then documents that lost too much."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from quilt.llm import common

#: Documents that keep less than this share of their word characters are rejected (per cent).
KEEP_PERCENT = 70
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line fails on marks when it has at least one of them for every four words.
WORDS_PER_MARK = 4
#: A line without an end mark fails when it has no more words than this.
SHORT_LINE = 5

SYMBOLS = r"[#*$%&|<>]"
#: Runs of symbols, or exclamation and question marks that stand doubled.
MARKS = r"[#*$%&<>~^=_{}\\]+|[!?]{2,}"
END_MARK = r"[.!?:;\x{2026}\"')\]\x{201D}\x{2019}\x{00BB}\x{3002}][\x20\x09-\x0D]*\z"
SEPARATORS = r"[|\x{00BB}\x{203A}\x{2022}\x{2192}]"
BOILERPLATE = (
    r"(?i)cookie|all rights reserved|privacy policy|terms of (use|service)|javascript|click here|subscribe|sign (in|up)|log ?in\b"
    r"|share this|read more|lorem ipsum|copyright|skip to (main )?content|back to top|follow us|powered by"
)
#: Longer lines are prose that mentions such words.
BOILERPLATE_WORDS = 12


def _python(pattern: str) -> str:
    return re.sub(r"\\x\{([0-9A-F]{4})\}", r"\\u\1", pattern).replace(r"\z", r"\Z")


_MARKS, _END, _SEPARATORS = (re.compile(_python(p)) for p in (MARKS, END_MARK, SEPARATORS))
_BOILERPLATE = re.compile(BOILERPLATE, re.ASCII)
_DROP_SPACE = {ord(c): None for c in " \t\n\x0b\x0c\r"}


def line_verdict(line: str, n_words: int) -> str | None:
    """The rule that a line with n_words > 0 words fails, or None."""
    if WORDS_PER_MARK * len(_MARKS.findall(line)) >= n_words:
        return "punctuation"
    if n_words <= SHORT_LINE and not _END.search(line):
        return "punctuation"
    n = len(_SEPARATORS.findall(line))
    if n >= 2 and 6 * n >= n_words:
        return "navigation"
    if n_words <= BOILERPLATE_WORDS and _BOILERPLATE.search(line):
        return "boilerplate"
    return None


def repeat_words(words: list) -> int:
    """Words inside a window of three that the text holds twice or more."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, until = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + 3 - max(i, until)
            until = i + 3
    return total


def judge(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, kept text, failed lines by rule."""
    text = text or ""
    data = text.encode()
    words = data.split()  # bytes split at ASCII white space alone
    n_words = len(words)
    word_chars = len(text.translate(_DROP_SPACE)) if n_words else 0
    n_symbols = len(data) - len(data.translate(None, b"#*$%&|<>"))
    seen, dup, lost, kept, failed = set(), 0, 0, [], Counter()
    for line in text.split("\n"):
        n = len(line.encode().split())
        if not n:
            continue
        dup += line in seen
        seen.add(line)
        rule = line_verdict(line, n)
        if rule:
            failed[rule] += 1
            lost += len(line.translate(_DROP_SPACE))
        else:
            kept.append(line)
    repeats = repeat_words(words)
    base_failed = n_words < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n_words
    ok = not base_failed and 100 * (word_chars - lost) >= KEEP_PERCENT * word_chars
    return n_words, word_chars, n_symbols, dup, repeats, base_failed, ok, "\n".join(kept), failed


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, the base figures, base_failed, kept, n_failed_lines, lost_chars; with_text adds the text left.

    A null or empty text has no words and fails. Lines without a word are
    dropped and count neither way. Repeated rows are each judged, a null id
    stays null, an empty table gives an empty result, other columns are
    ignored.
    """
    kind = df.select(f"`{id_col}`").schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_failed_lines long"
    names = [f.split()[0] for f in schema.split(", ")] + ["text"] * with_text
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()]

    def run(batches):
        for batch in batches:
            for part in common.by_bytes(batch, "text"):
                found = [judge(t) for t in part.column("text").to_pylist()]
                columns = list(zip(*[(*r[:7], sum(r[8].values())) for r in found]))
                arrays = [part.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types)]]
                if with_text:
                    arrays.append(pa.array([r[7] for r in found], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names)

    return common.picked(df, doc_id=id_col, text=text_col).mapInArrow(run, schema + ", text string" * with_text)


def kept_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that pass, all columns as they were but the text, which loses its failing lines."""
    names, at = df.columns, df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in common.by_bytes(batch, text_col):
                found = [judge(t) for t in part.column(text_col).to_pylist()]
                arrays = list(part.columns)
                arrays[at] = pa.array([r[7] for r in found], pa.string())
                yield pa.RecordBatch.from_arrays(arrays, names).filter(pa.array([r[6] for r in found], pa.bool_()))

    return df.mapInArrow(run, df.schema)


_S = r"\x20\x09-\x0D"
#: DuckDB SQL for the query's rows.
ORACLE = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^{_S}]+') AS words FROM t),
line AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM t),
counted AS (SELECT rid, line, pos, len(regexp_extract_all(line, '[^{_S}]+')) AS n FROM line),
ruled AS (SELECT rid, line, n, row_number() OVER (PARTITION BY rid, line ORDER BY pos) > 1 AS dup,
  length(regexp_replace(line, '[{_S}]', '', 'g')) AS chars,
  ({WORDS_PER_MARK} * len(regexp_extract_all(line, '{MARKS}')) >= n
   OR (n <= {SHORT_LINE} AND NOT regexp_matches(line, '{END_MARK.replace("'", "''")}'))
   OR (len(regexp_extract_all(line, '{SEPARATORS}')) >= 2 AND 6 * len(regexp_extract_all(line, '{SEPARATORS}')) >= n)
   OR (n <= {BOILERPLATE_WORDS} AND regexp_matches(line, '{BOILERPLATE}'))) AS failed
  FROM counted WHERE n > 0),
lines AS (SELECT rid, count(*) FILTER (WHERE dup) AS n_dup_lines, count(*) FILTER (WHERE failed) AS n_failed_lines,
  coalesce(sum(chars) FILTER (WHERE failed), 0) AS lost FROM ruled GROUP BY rid),
word AS (SELECT rid, unnest(words) AS a, generate_subscripts(words, 1) AS pos FROM w),
gram AS (SELECT rid, pos, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM word WINDOW o AS (PARTITION BY rid ORDER BY pos)),
twice AS (SELECT rid, pos, c IS NOT NULL AND count(*) OVER (PARTITION BY rid, a, b, c) > 1 AS again FROM gram),
covered AS (SELECT rid, bool_or(again) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM twice),
repeats AS (SELECT rid, count(*) FILTER (WHERE hit) AS n_repeat_words FROM covered GROUP BY rid),
figures AS (SELECT w.doc_id, len(words) AS n_words, length(regexp_replace(text, '[{_S}]', '', 'g')) AS word_chars,
  len(regexp_extract_all(text, '{SYMBOLS}')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  coalesce(n_failed_lines, 0) AS n_failed_lines, coalesce(lost, 0) AS lost
  FROM w LEFT JOIN lines USING (rid) LEFT JOIN repeats USING (rid)),
based AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM figures)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND 100 * (word_chars - lost) >= {KEEP_PERCENT} * word_chars AS kept, CAST(n_failed_lines AS BIGINT) AS n_failed_lines FROM based
"""
