"""Toxicity by a convolutional text classifier over hashed word embeddings, written and trained in numpy.

A word's embedding is the sum of table rows that hashes of the word and of its first 4, 5 and 6 letters pick, so
inflections of a stem meet. Filters of widths 1, 2 and 3 run over the whole text's words, each filter's greatest response
after a ReLU goes to a logistic layer. Filters are linear before the maximum, so every distinct word's share in them is
computed once and kept; a text is then sums of looked-up rows.

Thresholds are calibrated by the language that a text's function words show (the lang column is never read): for each
language the cut that suits its labels best, the common one where a language has too few toxic rows; scores are stretched
so that the cut lies at 0.3.

Defined cases: a null text is an empty one; a text without words has no responses and scores as such; repeated rows get
the same score; without labels of both kinds every document scores 0; texts of any length
are scored whole; ids are whole numbers or strings of one; other columns are dropped, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import held_out, mapped
from larkspur.llm.learning import Adam, best_threshold, labelled_sample, stretched

FLAG = 0.3
BUCKETS = 1 << 16
SIZE = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
LEADS = (4, 5, 6)
#: Words whose shares a process keeps.
CACHE_WORDS = 300_000
#: Training documents that must lead to a table row before it is learned.
LEAST_DOCUMENTS = 6
#: Of a table row's first number, before training, for each standard error of what the labels say of it.
START = 0.5
#: Toxic rows from which a language gets a threshold of its own.
OWN_CUT = 30
AT_ONCE = 128
#: What a missed share of toxic documents counts against a flagged share of others, which are many more.
CUT_WEIGHT = 0.25
_WORD = re.compile(r"\w+")
#: Frequent function words.
FUNCTION_WORDS = {
    "en": frozenset("the of and to in is that for it with was on be by this".split()),
    "fr": frozenset("le la les de des du et un une est dans pour que qui sur".split()),
    "de": frozenset("der die das und ist von zu den mit auf nicht ein eine für im".split()),
    "es": frozenset("el la los las de y en que un una por con para del se".split()),
}
LANGUAGES = (*FUNCTION_WORDS, "")


def split_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def languages(votes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Index in LANGUAGES of each text's language: whose function words are most frequent; the last one if there are none.

    ``votes``: for each word of the texts, one after the other, 1 for each language that has it as a function word.
    """
    sums = np.concatenate([np.zeros((1, votes.shape[1]), dtype=np.int64), np.cumsum(votes, axis=0, dtype=np.int64)])[np.concatenate([[0], ends])]
    counts = np.diff(sums, axis=0)
    return np.where(counts.any(axis=1), counts.argmax(axis=1), votes.shape[1])


def buckets(word: str) -> tuple[int, ...]:
    """The table rows of a word: of itself and its beginnings."""
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in (f"={word}", *(f"{n}{word[:n]}" for n in LEADS)))


COLUMNS = sum(WIDTHS) * FILTERS


@dataclass
class TextNet:
    """Weights: the table, the filters (one block of columns for each width and place in it), biases, output layer, cuts."""

    table: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    cuts: np.ndarray = field(default_factory=lambda: np.full(len(LANGUAGES), 0.5))

    def __post_init__(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1 << 10, COLUMNS), dtype=np.float32)
        self.votes = np.zeros((1 << 10, len(FUNCTION_WORDS)), dtype=bool)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "rows", "votes")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def _numbers(self, texts: list[list[str]]) -> np.ndarray:
        known = self.known
        missing = list(set().union(*texts).difference(known))
        if missing:
            if len(known) > CACHE_WORDS:
                known.clear()
                missing = list(set().union(*texts))
            first = len(known)
            known.update(zip(missing, range(first, first + len(missing)), strict=True))
            if len(known) > len(self.rows):
                self.rows, self.votes = (np.concatenate([x, np.zeros((len(known), x.shape[1]), dtype=x.dtype)]) for x in (self.rows, self.votes))
            self.rows[first : len(known)] = self.table[np.array(list(map(buckets, missing)))].sum(axis=1) @ self.filters
            self.votes[first : len(known)] = False
            for k, some in enumerate(FUNCTION_WORDS.values()):
                self.votes[[known[w] for w in some.intersection(missing)], k] = True
        return np.array([n for ws in texts for n in map(known.__getitem__, ws)], dtype=np.int64)

    def raw(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities before calibration, languages) of texts given as words."""
        ends = np.cumsum([len(ws) for ws in texts])
        numbers = self._numbers(texts)
        top, _ = responses(self.rows[numbers], ends, self.bias)
        p = 1 / (1 + np.exp(-np.clip(np.hstack([top, np.ones((len(texts), 1))]) @ self.out, -30, 30)))
        return p, languages(self.votes[numbers], ends)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(scores, languages) of texts; from 0.3 on a text is toxic."""
        p, langs = self.raw([split_words(t) for t in texts])
        return stretched(p, self.cuts[langs], FLAG).astype(np.float64), langs


def responses(flat: np.ndarray, ends: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greatest response of each filter in each text (at least 0), and at which word it begins (-1: nowhere).

    ``flat``: the words' shares in all filters, texts one after the other; ``ends``: where each text ends.
    """
    starts = np.concatenate([[0], ends[:-1]])
    n, top, where, column = len(flat), [], [], 0
    for width in WIDTHS:
        fits = ends - starts >= width
        best, at = np.zeros((len(ends), FILTERS), dtype=np.float32), np.full((len(ends), FILTERS), -1)
        if fits.any():
            total = flat[: n - width + 1, column : column + FILTERS].copy()
            for k in range(1, width):
                total += flat[k : n - width + 1 + k, column + k * FILTERS : column + (k + 1) * FILTERS]
            # places that reach into the next text respond with nothing
            for k in range(1, width):
                over = ends - k
                total[over[(over >= starts) & (over <= n - width)]] = -np.inf
            first = starts[fits]
            most = np.maximum.reduceat(total, first, axis=0)
            most += bias[len(top) * FILTERS : (len(top) + 1) * FILTERS]
            best[fits] = np.maximum(most, 0)
            where.append((total, fits))
        else:
            where.append((None, fits))
        top.append(best)
        column += width * FILTERS
    return np.hstack(top), where


def _arg_places(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.array([a + np.argmax(total[a : min(b, len(total))], axis=0) for a, b in zip(starts, ends, strict=True)])


def _evidence(ones: np.ndarray, zeros: np.ndarray, all_ones: int, all_zeros: int) -> np.ndarray:
    """Log odds of a row's toxic documents to its others, in standard errors."""
    odds = np.log((ones + 0.5) / (all_ones + 1)) - np.log((zeros + 0.5) / (all_zeros + 1))
    return odds / np.sqrt(1 / (ones + 0.5) + 1 / (zeros + 0.5))


def fit(texts: list[str], labels: np.ndarray, epochs: int = 2, batch: int = 64, rate: float = 0.03, decay: float = 0.05, seed: int = 7) -> TextNet:
    """A net from labelled texts; one in five is kept aside to calibrate the cuts (all are used where that leaves too few)."""
    rng = np.random.default_rng(seed)
    n_top = len(WIDTHS) * FILTERS
    table = rng.normal(0, 0.02, (BUCKETS, SIZE)).astype(np.float32)
    net = TextNet(table, rng.normal(0, 0.5, (SIZE, COLUMNS)).astype(np.float32), np.zeros(n_top, dtype=np.float32), np.concatenate([rng.normal(0, 0.5, n_top), [-1.0]]).astype(np.float32))
    if not (labels == 1).any() or not (labels == 0).any():
        net.out[:] = 0
        net.out[-1] = -30
        net.cuts[:] = 0.99
        return net
    words = [split_words(t) for t in texts]
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*words)))}
    picked = np.array([buckets(w) for w in vocabulary] or np.zeros((0, 1 + len(LEADS)), dtype=np.int64))
    # a table row that few documents lead to says nothing about others: it is nothing, and stays so
    seen = np.zeros((2, BUCKETS), dtype=np.int64)
    for ws, y in zip(words, labels, strict=True):
        seen[int(y), np.unique(picked[[vocabulary[w] for w in set(ws)]])] += 1
    common = seen.sum(axis=0) >= LEAST_DOCUMENTS
    table[~common] = 0
    # what the labels alone say of a row is where its first number, which the filters begin by looking at, starts
    table[:, 0] = np.where(common, START * _evidence(seen[1], seen[0], (labels == 1).sum(), (labels == 0).sum()), 0)
    net.filters[0] = np.abs(net.filters[0])
    numbers = [np.fromiter((vocabulary[w] for w in ws), dtype=np.int64, count=len(ws)) for ws in words]
    aside = np.arange(len(texts)) % 5 == 4 if min((labels == 1).sum(), (labels == 0).sum()) >= 100 else np.zeros(len(texts), dtype=bool)
    training = np.flatnonzero(~aside)
    share = np.where(labels == 1, 0.5 / (labels == 1).mean(), 0.5 / (labels == 0).mean())
    dense = {"filters": net.filters, "bias": net.bias, "out": net.out}
    learner = Adam(dense, rate)
    m, square = np.zeros_like(table), 0.0
    if len(training) < 1500:
        epochs = min(40, epochs * 1500 // len(training))
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(training), max(1, len(training) // batch)):
            ids, inverse = np.unique(np.concatenate([numbers[i] for i in part]), return_inverse=True)
            if not len(ids):
                continue
            vectors = table[picked[ids]].sum(axis=1)
            flat = (vectors @ net.filters)[inverse]
            ends = np.cumsum([len(numbers[i]) for i in part])
            starts = np.concatenate([[0], ends[:-1]])
            top, where = responses(flat, ends, net.bias)
            with_one = np.hstack([top, np.ones((len(part), 1))])
            p = 1 / (1 + np.exp(-np.clip(with_one @ net.out, -30, 30)))
            d = ((p - labels[part]) * share[part] / len(part)).astype(np.float32)
            g_top = d[:, None] * net.out[None, :-1] * (top > 0)
            grads = {"out": with_one.T @ d + 1e-4 * net.out, "bias": g_top.sum(axis=0), "filters": np.zeros_like(net.filters)}
            g_vectors, column = np.zeros_like(vectors), 0
            for w, width in enumerate(WIDTHS):
                total, fits = where[w]
                if total is not None:
                    places = _arg_places(total, starts[fits], ends[fits])
                    g = g_top[fits, w * FILTERS : (w + 1) * FILTERS]
                    for k in range(width):
                        at = inverse[places + k]
                        cols = slice(column + k * FILTERS, column + (k + 1) * FILTERS)
                        grads["filters"][:, cols] += np.einsum("tf,tfs->sf", g, vectors[at])
                        np.add.at(g_vectors, at, g[:, :, None] * net.filters[:, cols].T[None])
                column += width * FILTERS
            learner.step(grads)
            used = np.flatnonzero(np.abs(g_vectors).sum(axis=1))
            g_table = np.zeros_like(table)
            for j in range(picked.shape[1]):
                np.add.at(g_table, picked[ids[used], j], g_vectors[used])
            rows = np.flatnonzero(common & (np.abs(g_table).sum(axis=1) > 0))
            g = g_table[rows]
            # one scale for all rows: what many documents agree on moves further than what few do
            square += 0.05 * (float((g * g).mean() if len(rows) else 0.0) - square)
            m[rows] += 0.1 * (g - m[rows])
            table[rows] -= rate * (m[rows] / (np.sqrt(square) + 1e-9) + decay * table[rows])
    check = np.flatnonzero(aside) if aside.any() else training
    raw, langs = net.raw([words[i] for i in check])
    net.cuts[:] = best_threshold(raw, labels[check], CUT_WEIGHT)
    for k in range(len(LANGUAGES)):
        own = langs == k
        if (labels[check][own] == 1).sum() >= OWN_CUT and (labels[check][own] == 0).sum() >= OWN_CUT:
            net.cuts[k] = best_threshold(raw[own], labels[check][own], CUT_WEIGHT)
    net.known.clear()
    return net


def learn(docs: DataFrame, labels: DataFrame, **bounds: int) -> TextNet:
    """A net from the labelled documents that aren't held out; ``bounds`` as of labelled_sample()."""
    return fit(*labelled_sample(docs, labels, "toxic", **bounds))


def score_documents(docs: DataFrame, net: TextNet) -> DataFrame:
    """doc_id, score, guessed_lang of each document; the net is broadcast (a few MB, whatever the input)."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                part = b.slice(at, AT_ONCE)
                score, langs = net.scores([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array([LANGUAGES[k] for k in langs])], names=["doc_id", "score", "guessed_lang"])

    return mapped(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), run, "doc_id long, score double, guessed_lang string")


def digest(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= FLAG, 1).otherwise(0).alias("predicted"), "guessed_lang")
