"""What the two classifiers share: the sample to learn from, and thresholds put where a contract wants them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import held_out

#: Bounds of the sample that a model learns from, for each label value; the rest is only scored.
MAX_EACH = 3000
MAX_CHARS = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_each: int = MAX_EACH, max_chars: int = MAX_CHARS) -> tuple[list[str], np.ndarray]:
    """Texts and labels (0 or 1) of at most ``max_each`` rows of each label value, the same ones every time.

    Rows that are held out (crc32 of doc_id mod 4 is 2), without label or text, or of more than ``max_chars`` characters
    aren't learned from. Which rows: those of the smallest hash of doc_id; of rows that repeat a doc_id the smallest text.
    """
    known = labels.filter(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("__y")).dropDuplicates(["doc_id"])
    counts = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}
    # about as many hashes as are wanted lie below the cut, so no task gives the driver more than its share
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    cut = F.coalesce(*[F.when(F.col("__y") == y, F.lit(1.2 * max_each / n + 100 / n)) for y, n in counts.items()], F.lit(0.0))
    chosen = known.withColumn("__h", part).filter(F.col("__h") <= cut)
    texts = docs.filter(F.length("text") <= max_chars).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # rows that repeat a doc_id are one, so that what reaches the driver is bounded
    texts = texts.groupBy("doc_id", "__y", "__h").agg(F.min("text").alias("text"))
    rows = sorted(texts.collect(), key=lambda r: (r["__h"], r["doc_id"], r["text"]))
    rows = [r for y in (0, 1) for r in [x for x in rows if x["__y"] == y][:max_each]]
    rows.sort(key=lambda r: (r["__h"], r["doc_id"], r["text"]))
    return [r["text"] for r in rows], np.array([r["__y"] for r in rows], dtype=np.float64)


def best_threshold(scores: np.ndarray, labels: np.ndarray, weight_one: float = 0.5) -> float:
    """The cut that errs least, in the middle of the gap where it lies; 0.5 without both labels.

    ``weight_one``: what the share of label 1 below the cut counts, the share of label 0 above it counting the rest.
    """
    ones, zeros = labels == 1, labels == 0
    if not ones.any() or not zeros.any():
        return 0.5
    order = np.argsort(scores, kind="stable")
    s, y = scores[order], labels[order]
    below_one = np.concatenate([[0], np.cumsum(y == 1)]) / ones.sum()
    above_zero = 1 - np.concatenate([[0], np.cumsum(y == 0)]) / zeros.sum()
    edges = np.concatenate([[0.0], (s[1:] + s[:-1]) / 2, [1.0]])
    wrong = weight_one * below_one + (1 - weight_one) * above_zero
    wrong[1:-1][s[1:] == s[:-1]] = np.inf
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float(np.clip(edges[best[len(best) // 2]], 1e-6, 1 - 1e-6))


def stretched(scores: np.ndarray, threshold: np.ndarray | float, at: float) -> np.ndarray:
    """Scores moved within 0 to 1, in order, so that ``threshold`` comes to be ``at``."""
    low = scores / threshold * at
    high = at + (scores - threshold) / (1 - threshold) * (1 - at)
    return np.clip(np.where(scores < threshold, low, high), 0.0, 1.0)


class Adam:
    """Steps of stochastic gradient descent by Adam over a dictionary of arrays."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.weights, self.rate, self.t = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, gradients: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in gradients.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.999**self.t)
            self.weights[k] -= self.rate * m / (np.sqrt(v) + 1e-8)
