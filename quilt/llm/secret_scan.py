"""Secret scans: every rule in one pass over the bytes.

All rules are compiled into one automaton (see automaton). Its pass finds where
matches end; the few ends found are read backwards by the rule's own reversed
automaton, which gives the leftmost start that no earlier match of the rule has
used. That is the leftmost non-overlapping match for rules whose last part is a
run of one class, as all rules here have, or that have a fixed end.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quilt.llm import common
from quilt.llm.automaton import compile_rules


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
_SEPARATOR = r"""["']?\x20*[:=]\x20*["']?"""
#: (kind, pattern, least length of a match); the first three are the base kinds. Lengths are held to after the pass:
#: counting them in the automaton would multiply its states. Runs of three hex digits are too common to be looked at.
RULES = (
    ("assign", rf"({_KEYWORDS}){_SEPARATOR}[A-Za-z0-9+/_.=\-]+", 0),
    ("access", r"AKIA[A-Z0-9]+", 18),
    ("hex", r"[0-9a-f]{4,}", 16),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9\-]+", 15),
    ("google", r"AIza[0-9A-Za-z_\-]+", 39),
    ("stripe", r"[sr]k_live_[0-9A-Za-z]+", 32),
)
BASE = 3
LEAST_VALUE = 12
_VALUE = re.compile(rf"(?:{_KEYWORDS}){_SEPARATOR}([A-Za-z0-9+/_.=\-]+)".encode())


@cache
def automata():
    """The forward automaton of all rules and each rule's reversed one."""
    patterns = [p for _, p, _ in RULES]
    return compile_rules(patterns), [compile_rules([p], anchored=True, backward=True) for p in patterns]


def scan_bytes(data: bytes, compiled: tuple | None = None) -> list[tuple[int, int, int]]:
    """(start, end, rule number) of the matches in data, in bytes, in order of start and rule."""
    forward, backward = compiled or automata()
    table, special, accepts = forward.table, forward.special, forward.accepts
    ends: dict[int, int] = {}
    used: dict[int, int] = {}
    found = []

    def close(k: int, end: int) -> None:
        """A stretch of accepting states of rule k has ended: read back to its leftmost unused start."""
        a, s, start, limit = backward[k], 0, -1, used.get(k, 0)
        back = a.table
        for i in range(end - 1, limit - 1, -1):
            s = back[s | data[i]]
            if s >= a.special:
                start = i
            elif s == a.dead:
                break
        if start >= 0:
            used[k] = end
            kind, _, least = RULES[k]
            if end - start >= least and (kind != "assign" or len(_VALUE.fullmatch(data, start, end)[1]) >= LEAST_VALUE):
                found.append((start, end, k))

    s = 0
    for i, b in enumerate(data):
        s = table[s | b]
        if s >= special:
            for k in accepts[s >> 8]:
                if ends.get(k, i) != i:
                    close(k, ends[k])
                ends[k] = i + 1
    for k, end in ends.items():
        close(k, end)
    return sorted(found, key=lambda x: (x[0], x[2]))


def scan(text: str | None, compiled: tuple | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points; end exclusive."""
    data = (text or "").encode()
    found = scan_bytes(data, compiled)
    if found and not data.isascii():
        points = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        at = lambda i: int(points[i - 1]) if i else 0
        found = [(at(a), at(b), k) for a, b, k in found]
    return [(a, b, RULES[k][0]) for a, b, k in found]


_BASE_KINDS = tuple(kind for kind, _, _ in RULES[:BASE])


def secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row's whole text.

    A null text counts as empty; repeated rows are each scanned, a null id
    stays null, an empty table gives an empty result, other columns are
    ignored.
    """
    kind = df.select(f"`{id_col}`").schema[0].dataType.simpleString()
    shipped = df.sparkSession.sparkContext.broadcast(automata())  # its size hangs on the rules alone

    def run(batches):
        compiled = shipped.value
        for batch in batches:
            for part in common.by_bytes(batch, "text"):
                counts: list[list[int]] = [[], [], []]
                digests, spans = [], []
                for text in part.column("text").to_pylist():
                    found = scan(text, compiled)
                    for n, name in zip(counts, _BASE_KINDS):
                        n.append(sum(k == name for _, _, k in found))
                    base = ",".join(f"{k}:{a}:{b}" for a, b, k in found if k in _BASE_KINDS)
                    digests.append(hashlib.sha256(base.encode()).hexdigest())
                    spans.append(",".join(f"{k}:{a}:{b}" for a, b, k in found))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(n, pa.int64()) for n in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return common.picked(df, doc_id=id_col, text=text_col).mapInArrow(run, schema)
