"""Document quality by a linear-chain conditional random field over lines.

Every line has features of its own (length, shares of upper case, digits, punctuation and symbols, repeated words, and so
on); the field's score for "good" sees those of the line and of its two neighbours, and a 2 x 2 matrix scores labels of
adjacent lines. Forward-backward gives each line's marginal of being good; a document's score is their mean weighted by
line length, stretched so that the cut that suits the labels best lies at 0.7.

Labels are of documents. The field first learns with all lines of a document labelled like it; then, twice, lines of bad
documents that the field finds good are relabelled (never all of a document's) and it learns again.

Defined cases: a null text is an empty one; a text without lines that hold something has one empty line; repeated rows get
the same score; without labels of both kinds every document scores 1 (but for rounding); texts of any length
are scored whole; ids are whole numbers or strings of one; other columns are dropped by scores, whatever their names, and
kept as they are by ``keep_good``; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import held_out, mapped
from larkspur.llm.learning import Adam, best_threshold, labelled_sample, stretched

KEEP = 0.7
FEATURES = 12
#: Rows of each label that the field learns from, at most; the rest is only scored.
MAX_EACH = 1500
AT_ONCE = 256
_LOWER, _UPPER, _DIGIT, _SPACE, _PUNCTUATION, _SYMBOL = range(6)


@cache
def _classes() -> np.ndarray:
    """The class of each code point of the basic plane; one more for all above."""
    usual = set(".,;:'\"()-?’“”«»¿¡")
    kinds = {"Lu": _UPPER, "Lt": _UPPER, "Nd": _DIGIT, "Zs": _SPACE}

    def kind(c: str) -> int:
        k = unicodedata.category(c)
        if c in "\t\r\n":
            return _SPACE
        return _PUNCTUATION if c in usual else kinds.get(k, _LOWER if k[0] in "LM" else _SYMBOL)

    return np.array([kind(chr(i)) for i in range(0x10000)] + [_SYMBOL], dtype=np.uint8)


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, lengths) of a text's lines."""
    lines = text.split("\n")
    sizes = np.array(list(map(len, lines)), dtype=np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = _classes()[np.minimum(codes, 0x10000)]
    ends = np.concatenate([[0], np.cumsum(sizes + 1)])
    x = np.zeros((len(lines), FEATURES))
    some = np.maximum(sizes, 1)
    for k in (_UPPER, _DIGIT, _PUNCTUATION, _SYMBOL, _SPACE):
        counts = np.concatenate([[0], np.cumsum(kinds == k)])
        counts = np.append(counts, counts[-1])
        x[:, k - 1] = (counts[ends[1:] - 1] - counts[ends[:-1]]) / some
    seen: set[str] = set()
    for i, line in enumerate(lines):
        ws = line.split()
        n = len(ws)
        if n:
            x[i, 5:9] = np.log1p(n) / 5, sum(map(eq, ws, ws[1:])) / n, len(set(ws)) / n, min(len(line) / n / 10, 3)
        else:
            x[i, 9] = 1
        x[i, 10] = line in seen
        seen.add(line)
    x[0, 11] = 1
    return x, sizes


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Each line's features, the previous and the next line's, and 1."""
    none = np.zeros((1, x.shape[1]))
    return np.hstack([x, np.vstack([none, x[:-1]]), np.vstack([x[1:], none]), np.ones((len(x), 1))])


def _sum_exp(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def marginals(unary: list[np.ndarray], pair: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Forward-backward over all sequences at once: P(good) of each line, and expected counts of adjacent labels.

    ``unary``: the score of "good" for each line of each sequence; "bad" scores 0.
    """
    order = sorted(range(len(unary)), key=lambda i: -len(unary[i]))
    sizes = np.array([len(unary[i]) for i in order])
    steps, n = int(sizes[0]), len(order)
    active = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(steps)]  # sequences longer than t
    ends = np.concatenate([[0], np.cumsum(active)])
    flat = np.zeros((ends[-1], 2))
    where = np.concatenate([ends[: len(unary[i])] + k for k, i in enumerate(order)])
    flat[where, 1] = np.concatenate([unary[i] for i in order])
    forward = np.empty_like(flat)
    forward[:n] = flat[:n]
    for t in range(1, steps):
        a, b, m = ends[t - 1], ends[t], active[t]
        forward[b : b + m] = flat[b : b + m] + _sum_exp(forward[a : a + m, :, None] + pair, 1)
    backward, counts = np.zeros_like(flat), np.zeros((2, 2))
    z = np.empty(n)
    last = ends[sizes - 1] + np.arange(n)
    z[:] = _sum_exp(forward[last], 1)
    for t in range(steps - 1, 0, -1):
        a, b, m = ends[t - 1], ends[t], active[t]
        after = flat[b : b + m] + backward[b : b + m]
        both = forward[a : a + m, :, None] + pair + after[:, None, :]
        counts += np.exp(both - z[:m, None, None]).sum(axis=0)
        backward[a : a + m] = _sum_exp(pair + after[:, None, :], 2)
    depth = np.concatenate([np.arange(m) for m in active])
    good = np.exp(np.minimum(forward[:, 1] + backward[:, 1] - z[depth], 0.0))
    out = np.split(good[where], np.cumsum(sizes)[:-1])
    back: list[np.ndarray] = [np.empty(0)] * n
    for k, i in enumerate(order):
        back[i] = out[k]
    return back, counts


@dataclass
class LineField:
    """A fitted field: weights of the line's features, scores of adjacent labels, feature scales, and the cut."""

    weights: np.ndarray
    pair: np.ndarray
    cut: float = 0.5

    def lines(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """P(good) and length of each line of each text."""
        each = [line_features(t) for t in texts]
        p, _ = marginals([with_neighbours(x) @ self.weights for x, _ in each], self.pair)
        return p, [n for _, n in each]

    def raw(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        return np.array([float(p @ (n + 1) / (n + 1).sum()) for p, n in zip(*self.lines(texts), strict=True)])

    def scores(self, texts: list[str]) -> np.ndarray:
        """Of each text, 0 to 1; from 0.7 on it is good."""
        return stretched(self.raw(texts), self.cut, KEEP)


def fit(texts: list[str], labels: np.ndarray, rounds: int = 3, steps: int = 80, rate: float = 0.1, decay: float = 1e-4) -> LineField:
    """The field that explains the labels of documents, by gradient ascent on the likelihood of its line labels."""
    width = 3 * FEATURES + 1
    field = LineField(np.zeros(width), np.zeros((2, 2)))
    if not (labels == 1).any() or not (labels == 0).any():
        field.weights[-1] = 30.0
        return field
    rows = [with_neighbours(line_features(t)[0]) for t in texts]
    x, ends = np.vstack(rows), np.cumsum([len(r) for r in rows])[:-1]
    y = [np.full(len(r), v) for r, v in zip(rows, labels, strict=True)]
    share = np.where(labels == 1, 0.5 / (labels == 1).mean(), 0.5 / (labels == 0).mean())
    weight = {"w": field.weights, "pair": field.pair}
    for again in range(rounds):
        if again:  # what looks good in a bad document is good
            p, _ = marginals(np.split(x @ field.weights, ends), field.pair)
            y = [v if labels[i] == 1 or (p[i] > 0.5).all() else (p[i] > 0.5).astype(float) for i, v in enumerate(y)]
        target = np.concatenate(y)
        of_line = np.concatenate([np.full(len(r), s / len(r)) for r, s in zip(rows, share, strict=True)])
        pairs = np.zeros((2, 2))
        for v in y:
            np.add.at(pairs, (v[:-1].astype(int), v[1:].astype(int)), 1)
        n_pairs = max(1.0, pairs.sum())
        learner = Adam(weight, rate)
        for _ in range(steps):
            p, counts = marginals(np.split(x @ field.weights, ends), field.pair)
            g = x.T @ ((np.concatenate(p) - target) * of_line) / len(rows) + decay * field.weights
            learner.step({"w": g, "pair": (counts - pairs) / n_pairs + decay * field.pair})
    field.cut = best_threshold(field.raw(texts), labels)
    return field


def learn(docs: DataFrame, labels: DataFrame, max_each: int = MAX_EACH, **bounds: int) -> LineField:
    """A field from the labelled documents that aren't held out; ``bounds`` as of labelled_sample()."""
    return fit(*labelled_sample(docs, labels, "quality", max_each, **bounds))


def _scored(batch: pa.RecordBatch, column: int, field: LineField) -> np.ndarray:
    texts = [t or "" for t in batch.column(column).to_pylist()]
    return field.scores(texts)


def score_documents(docs: DataFrame, field: LineField) -> DataFrame:
    """doc_id, score, n_lines, n_good of each document; each task reads its own input once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                part = b.slice(at, AT_ONCE)
                texts = [t or "" for t in part.column(1).to_pylist()]
                p, sizes = field.lines(texts)
                raw = np.array([float(q @ (n + 1) / (n + 1).sum()) for q, n in zip(p, sizes, strict=True)])
                score = stretched(raw, field.cut, KEEP)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array([len(q) for q in p], pa.int64()), pa.array([int((q > 0.5).sum()) for q in p], pa.int64())], names=["doc_id", "score", "n_lines", "n_good"])

    return mapped(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), run, "doc_id long, score double, n_lines long, n_good long")


def label_lines(docs: DataFrame, field: LineField) -> DataFrame:
    """doc_id, line (from 0), p_good of every line."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                part = b.slice(at, AT_ONCE)
                p, _ = field.lines([t or "" for t in part.column(1).to_pylist()])
                of = np.repeat(np.arange(part.num_rows), [len(q) for q in p])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), pa.array(np.concatenate([np.arange(len(q)) for q in p])), pa.array(np.concatenate(p))], names=["doc_id", "line", "p_good"])

    return mapped(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), run, "doc_id long, line long, p_good double")


def keep_good(docs: DataFrame, field: LineField, at: float = KEEP) -> DataFrame:
    """The documents that score ``at`` or more, with all their columns."""
    column = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, AT_ONCE):
                part = b.slice(start, AT_ONCE)
                yield part.filter(pa.array(_scored(part, column, field) >= at))

    return mapped(docs, run, docs.schema)


def digest(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= KEEP, 1).otherwise(0).alias("predicted"), "n_lines", "n_good")
