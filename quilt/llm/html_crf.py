"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

Each block is main text or not. The chain's weights are trained on labelled
pages (by default the generated ones of html_training), on the driver, within
a bounded number of pages; executors decode every page by Viterbi.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quilt.llm import common
from quilt.llm.html_blocks import Block, blocks, path_features, text_features

#: Labelled pages that training takes at most, steps and step width, weight of the L2 penalty.
TRAINING_PAGES = 600
STEPS, RATE, PENALTY = 150, 0.3, 1e-3


class Chain:
    """Two labels; a feature's weight speaks for label 1, transitions[a][b] for label b after label a."""

    def __init__(self, weights: dict[str, float], transitions: list[list[float]]):
        self.weights, self.transitions = weights, transitions
        self._paths: dict = {}

    def scores(self, found: list[Block]) -> list[float]:
        out, get, before = [], self.weights.get, None
        for i, b in enumerate(found):
            known = self._paths.get(b.path)
            if known is None:
                if len(self._paths) > 50_000:
                    self._paths.clear()
                known = self._paths[b.path] = sum(get(f, 0.0) for f in path_features(b.path))
            out.append(known + sum(get(f, 0.0) for f in text_features(b, i, len(found), before)))
            before = b
        return out

    def decode(self, scores: list[float]) -> list[int]:
        """Labels of the best path (Viterbi); ties go to label 0."""
        if not scores:
            return []
        (t00, t01), (t10, t11) = self.transitions
        zero, one, back = 0.0, scores[0], []
        for s in scores[1:]:
            from0, from1 = zero + t00 < one + t10, zero + t01 < one + t11
            back.append((from0, from1))
            zero, one = (one + t10 if from0 else zero + t00), (one + t11 if from1 else zero + t01) + s
        label = int(one > zero)
        labels = [label]
        for pair in reversed(back):
            label = int(pair[label])
            labels.append(label)
        return labels[::-1]

    def extract(self, html: str | None) -> str:
        found = blocks(html)
        return "\n".join(b.text for b, y in zip(found, self.decode(self.scores(found))) if y)


class Evidence:
    """Labelled pages, (blocks, labels) each, as arrays: features of blocks, and blocks and gold labels by page and place."""

    def __init__(self, pages: list[tuple[list[Block], list[int]]]):
        names: dict[str, int] = {}
        rows, cols, at = [], [], 0
        longest = max(len(found) for found, _ in pages)
        self.place = np.full((len(pages), longest), -1)
        self.gold = np.zeros((len(pages), longest), dtype=int)
        for k, (found, labels) in enumerate(pages):
            before = None
            for i, b in enumerate(found):
                for f in path_features(b.path) + text_features(b, i, len(found), before):
                    rows.append(at)
                    cols.append(names.setdefault(f, len(names)))
                self.place[k, i], self.gold[k, i], before = at, labels[i], b
                at += 1
        self.names, self.n_blocks, self.rows, self.cols = names, at, np.array(rows), np.array(cols)
        self.there = self.place >= 0
        self.both = self.there[:, 1:]
        gold = self.gold
        self.gold_t = np.array([[((gold[:, :-1] == a) & (gold[:, 1:] == b) & self.both).sum() for b in (0, 1)] for a in (0, 1)])

    def likelihood(self, w: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log likelihood of the gold labels and its gradients by the features' weights and by the transitions (forward and backward sums)."""
        place, gold, there, both = self.place, self.gold, self.there, self.both
        n_pages, longest = place.shape
        emit = np.zeros((n_pages, longest, 2))
        emit[..., 1] = np.where(there, np.bincount(self.rows, weights=w[self.cols], minlength=self.n_blocks)[place], 0)
        alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
        alpha[:, 0] = emit[:, 0]
        for i in range(1, longest):
            step = np.logaddexp(alpha[:, i - 1, 0, None] + t[0], alpha[:, i - 1, 1, None] + t[1]) + emit[:, i]
            alpha[:, i] = np.where(there[:, i, None], step, alpha[:, i - 1])
        for i in range(longest - 2, -1, -1):
            after = beta[:, i + 1] + emit[:, i + 1]
            step = np.stack([np.logaddexp(t[a, 0] + after[:, 0], t[a, 1] + after[:, 1]) for a in (0, 1)], axis=1)
            beta[:, i] = np.where(there[:, i + 1, None], step, 0)
        log_z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        one = np.exp(alpha[..., 1] + beta[..., 1] - log_z[:, None])
        wrong = np.zeros(self.n_blocks)
        wrong[place[there]] = (gold - one)[there]
        grad_t = self.gold_t.astype(float)
        for a in (0, 1):
            for b in (0, 1):
                joint = alpha[:, :-1, a] + t[a, b] + emit[:, 1:, b] + beta[:, 1:, b] - log_z[:, None]
                grad_t[a, b] -= np.exp(np.where(both, joint, -np.inf)).sum()
        total = (emit[..., 1] * gold * there).sum() + (self.gold_t * t).sum() - log_z.sum()
        return float(total), np.bincount(self.cols, weights=wrong[self.rows], minlength=len(self.names)), grad_t


def train(pages: list[tuple[list[Block], list[int]]], steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> Chain:
    """Maximum likelihood over (blocks, labels) of labelled pages, by AdaGrad on the whole set."""
    evidence = Evidence([p for p in pages[:TRAINING_PAGES] if p[0]])
    n = len(evidence.place)
    w, t = np.zeros(len(evidence.names)), np.zeros((2, 2))
    seen_w, seen_t = np.full(len(w), 1e-8), np.full((2, 2), 1e-8)
    for _ in range(steps):
        _, grad_w, grad_t = evidence.likelihood(w, t)
        grad_w -= penalty * n * w
        seen_w += grad_w**2
        seen_t += grad_t**2
        w += rate * grad_w / np.sqrt(seen_w)
        t += rate * grad_t / np.sqrt(seen_t)
    return Chain({f: float(w[i]) for f, i in evidence.names.items()}, t.tolist())


@cache
def default_chain() -> Chain:
    from quilt.llm.html_training import labelled_pages

    return train(labelled_pages())


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chain: Chain | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row's whole html.

    Blocks decoded as main text, joined in page order by line feeds; an empty
    string where there are none, as for a null or empty html. Repeated rows
    are each extracted, null ids and urls stay null, an empty table gives an
    empty result, other columns are ignored.
    """
    chain = chain or default_chain()
    weights, transitions = chain.weights, chain.transitions
    kinds = [df.select(f"`{c}`").schema[0].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches):
        own = Chain(weights, transitions)
        for batch in batches:
            for part in common.by_bytes(batch, "html"):
                texts = [own.extract(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return common.picked(df, page_id=id_col, url=url_col, html=html_col).mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
