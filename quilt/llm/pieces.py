"""Byte-level BPE over whole texts, split at safe boundaries.

The pre-tokenizer of the vocabulary never lets a token run from a character
that isn't white space into one that is, so a text may be cut wherever white
space follows anything else: the pieces' ids, joined, are the text's ids.
Pieces recur, so a batch is cut and its distinct pieces are found in Arrow, each
worker remembers the ids of the pieces it met, and only new ones go to the
library: plain words straight to its merges, others joined to strings of some
size and cut apart again by the byte length of their tokens. Vocabularies of
another kind are known by their file and go to the library text by text.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quilt.llm import common

#: The white space of the pre-tokenizer's pattern (Unicode White_Space), the two common ones apart.
_RARE = r"\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = r" \n" + _RARE
_PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Texts with a match have white space side by side, at an end or of the rare kind; all others are cut at spaces and line feeds alone.
_UNEVEN = r"  |\n\n| \n|\n |\A[ \n]|[ \n]\z|" + f"[{_RARE.encode().decode('unicode_escape')}]"
#: Letters, then signs: one word and one run of signs to the pre-tokenizer. A space goes to the word, a line feed stands alone.
_LATIN = re.compile(r"([\r\n]?)([A-Za-zÀ-ÖØ-öø-ž]+)([!-/:-@\[-`{-~]*)").fullmatch
_WHITE = re.compile(f"[{SPACE}]")
#: Pieces remembered by a worker, and the longest one remembered; neither changes a result. A full memory stays as it
#: is (frequent pieces come early) until a group has more than this share of pieces that it lacks.
MEMORY, LONGEST, STALE = 500_000, 64, 0.5


class Pieces:
    """Ids (little-endian uint32 bytes) or lengths of texts under one vocabulary file."""

    def __init__(self, path: str, lengths_only: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.ones(max(vocab.values(), default=0) + 1, dtype=np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token)  # one character of the vocabulary stands for one byte
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            self.width[i] = len(token.content.encode())
        self.lengths_only = lengths_only
        self.known: dict = {}
        self.by_pieces = self._cuts_at_space(json.loads(self.tokenizer.to_str()))
        # The vocabulary writes a byte as one character: printable Latin-1 as it is, the others from 256 on in order.
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        self.symbols = [chr(b if b in plain else next(others)) for b in range(256)]

    @staticmethod
    def _cuts_at_space(kind: dict) -> bool:
        """Whether texts may be cut as they are here: byte-level BPE by the usual pattern, and nothing around it."""
        before, model = kind["pre_tokenizer"] or {}, kind["model"]
        own = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        plain = not (kind["normalizer"] or kind["truncation"] or kind["padding"] or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
        whole = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or _WHITE.search(t["content"]) for t in kind["added_tokens"])
        return bool(own and plain and whole and model.get("type") == "BPE")

    def _cut_uneven(self, text: str) -> list[str]:
        """Pieces of a text as _cut leaves them."""
        found = _PIECE.findall(text)
        return ["\r" + found[0]] + [p[1:] if p[0] == " " and p[1:] and not _WHITE.match(p, 1) else "\r" + p for p in found[1:]]

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, pa.DictionaryArray]:
        """Rows in the order they are cut in, the pieces' bounds by row and the pieces.

        The single space before a word is left off; "\\r" marks a piece that is kept as it is, such as a text's first.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        uneven = pc.match_substring_regex(texts, _UNEVEN)
        rows = pc.array_sort_indices(uneven.cast(pa.int8()))
        even = pc.binary_join_element_wise(pa.scalar("\r", pa.large_string()), texts.filter(pc.invert(uneven)), pa.scalar("", pa.large_string()))
        lists = [pc.split_pattern(pc.replace_substring(even, "\n", " \n"), " "), pa.array(map(self._cut_uneven, texts.filter(uneven).to_pylist()), pa.list_(pa.large_string()))]
        bounds = np.cumsum(np.concatenate([[0], *(pc.list_value_length(x).to_numpy() for x in lists)]))
        return rows, bounds, pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()

    def _joined(self, raw: list[str]) -> list:
        """Values of pieces that begin with white space and end with anything else, encoded 200 at a time as one string."""
        texts = ["".join(raw[i : i + 200]) for i in range(0, len(raw), 200)]
        ids = np.concatenate([np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        ends, want = np.cumsum(self.width[ids]), np.cumsum([len(p.encode()) for p in raw])
        cuts = np.searchsorted(ends, want) + 1
        if not np.array_equal(ends[cuts - 1], want):
            raise RuntimeError("a piece doesn't end where a token ends")
        if self.lengths_only:
            return np.diff(cuts, prepend=0).tolist()
        data, bounds = ids.tobytes(), (cuts * 4).tolist()
        return [data[a:b] for a, b in zip([0, *bounds], bounds)]

    def _new(self, pieces: list[str]) -> dict:
        """Values of pieces as _cut leaves them, and of the parts they are put together from."""
        out, plain, other = {}, [], []
        merge, symbols, lengths, known = self.tokenizer.model.tokenize, self.symbols.__getitem__, self.lengths_only, self.known

        def word(key: str):
            value = out.get(key) or known.get(key)
            if value is None:
                found = key if key.isascii() else "".join(map(symbols, key.encode()))
                found = merge("Ġ" + found if key[0] != "\r" else found[1:] if key.isascii() else found[len(self.symbols[13]) :])
                value = out[key] = len(found) if lengths else array("I", [t.id for t in found]).tobytes()
            return value

        def signs(run: str):
            key = "\r" + run
            value = out.get(key) or known.get(key)
            if value is None:
                value = out[key] = self._heads([run])[0]
            return value

        # A piece is led by its space unless it starts with a line feed; "\r" marks one that is kept as it is.
        for p in pieces:
            parts = _LATIN(p)
            if parts:
                lead, letters, tail = parts.groups()
                value = word(lead and "\r" + letters or letters)
                if lead == "\n":
                    value = signs(lead) + value
                out[p] = value + signs(tail) if tail else value
            elif p[0] == "\r" or _WHITE.match(p[-1]):
                other.append(p)
            else:
                plain.append(p)
        if plain:
            out.update(zip(plain, self._joined([p if p[0] == "\n" else " " + p for p in plain])))
        if other:
            out.update(zip(other, self._heads([p if p[0] == "\n" else p[1:] if p[0] == "\r" else " " + p for p in other])))
        return out

    def _heads(self, heads: list[str]) -> list:
        """Pieces with no other before them to part them from, encoded one by one."""
        out = []
        for e in self.tokenizer.encode_batch_fast(heads, add_special_tokens=False) if heads else []:
            out.append(len(e.ids) if self.lengths_only else np.array(e.ids, dtype="<u4").tobytes())
        return out

    def _values(self, distinct: list[str], pieces: int) -> list:
        """Values of the distinct pieces of a batch of so many pieces."""
        found = list(map(self.known.get, distinct))
        missing = [p for p, v in zip(distinct, found) if v is None]
        if missing:
            got = self._new(missing)
            found = [got[p] if v is None else v for p, v in zip(distinct, found)]
            if len(self.known) < MEMORY:
                self.known.update((p, v) for p, v in got.items() if len(p) <= LONGEST)
            elif len(missing) > STALE * pieces:
                self.known = {}
        return found

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order (none with lengths only) and the number of ids of each; a null is an empty text."""
        if not len(texts):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        if not self.by_pieces:  # a vocabulary of another kind: whole texts
            found = [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]
            n = np.array([len(x) for x in found], dtype=np.int64)
            return np.empty(0, "<u4") if self.lengths_only else np.concatenate(found), n
        rows, bounds, pieces = self._cut(texts)
        found = self._values(pieces.dictionary.to_pylist(), len(pieces))
        width = np.array(found if self.lengths_only else [len(v) // 4 for v in found], dtype=np.int64)
        at = pieces.indices.to_numpy()
        n = np.empty(len(texts), dtype=np.int64)
        n[rows.to_numpy()] = np.add.reduceat(width[at], bounds[:-1])
        if self.lengths_only:
            return np.empty(0, "<u4"), n
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(width)]), pa.array(np.frombuffer(b"".join(found), "<u4")))
        back = pa.LargeListArray.from_arrays(bounds, pieces.indices).take(pc.array_sort_indices(rows)).flatten()
        return lists.take(back).flatten().to_numpy(), n

    def ids(self, texts: list[str | None]) -> list[bytes]:
        values, n = self.encoded(pa.array(texts, pa.large_string()))
        ends = np.cumsum(n).tolist()
        return [values[a:b].tobytes() for a, b in zip([0, *ends], ends)]

    def lengths(self, texts: list[str | None]) -> list[int]:
        return self.encoded(pa.array(texts, pa.large_string()))[1].tolist()


def worker_pieces(path: str, lengths_only: bool) -> Pieces:
    """One instance for each Python worker, kept between tasks until other work needs its memory."""
    return common.kept(("pieces", path, lengths_only), lambda: Pieces(path, lengths_only))
