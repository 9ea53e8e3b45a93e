"""Models behind interfaces: embedders, rerankers, judges, web searches, rewriters, chat.

Every model is a callable. Those that speak HTTP run on the driver over the few rows of a result list, or inside
``embed_column`` on executors, batch by batch. ``hashed_embedding`` needs no model and gives the same vector everywhere.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from email.utils import parsedate_to_datetime

from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StringType, StructField, StructType

from larkspur.functions.text import let, run_lengths, tokenize
from larkspur.functions.vectors import l2_normalized
from larkspur.operators.corrective import HIGH, LOW, UNCERTAIN
from larkspur.sources.batching import MAX_TEXTS, in_batches
from larkspur.sources.shipping import mapped

Embedder = Callable[[list[str]], list[list[float]]]

if TYPE_CHECKING:
    from larkspur.operators.rewrite import RewriteRules


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """A unit vector of a text's tokens: each counts where its hash points, up or down. Native, deterministic."""
    place = lambda w: 2 * F.pmod(F.xxhash64(w), F.lit(size)) + F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2))
    # each token is looked at once; what is looked through for each number has two entries for each at most
    counted = F.map_from_entries(run_lengths(F.transform(tokenize(text), place), "at", "n", "bigint"))
    times = lambda m, at: F.coalesce(F.try_element_at(m, at), F.lit(0))
    return let(counted, lambda m: l2_normalized(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (times(m, (2 * i).cast("long")) - times(m, (2 * i + 1).cast("long"))).cast("double"))))


class HttpError(RuntimeError):
    """An answer that isn't 2xx."""

    def __init__(self, status: int, body: str, retry_after: float = 0.0):
        super().__init__(f"status {status}: {body[:200]}")
        self.status, self.retry_after = status, retry_after


def join_url(base: str, path: str) -> str:
    """``base`` and ``path``, with /v1 between them where the base names no version."""
    base = base.rstrip("/")
    last = base.rpartition("/")[2]
    versioned = last[:1] == "v" and last[1:].isdigit()
    return f"{base}{path}" if versioned else f"{base}/v1{path}"


def retry_after(value: str | None, now: float | None = None) -> float:
    """Seconds that a Retry-After header asks for: a number or a date; 0 for anything else."""
    if not value:
        return 0.0
    try:
        return max(0.0, float(value))
    except ValueError:
        pass
    try:
        return max(0.0, parsedate_to_datetime(value).timestamp() - (time.time() if now is None else now))
    except (ValueError, TypeError):
        return 0.0


def post(url: str, body: dict, api_key: str = "", timeout: float | None = 30) -> dict:
    """The JSON answer to a JSON request."""
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {api_key}"} if api_key else {})
    request = urllib.request.Request(url, json.dumps(body).encode(), headers)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.loads(answer.read())
    except urllib.error.HTTPError as e:
        raise HttpError(e.code, e.read().decode(errors="replace"), retry_after(e.headers.get("Retry-After"))) from e


def retryable(error: Exception) -> bool:
    """Too many requests, server errors, and connections that failed."""
    if isinstance(error, HttpError):
        return error.status == 429 or error.status >= 500
    return isinstance(error, (urllib.error.URLError, TimeoutError, ConnectionError))


@dataclass
class HttpEmbedder:
    """An embeddings service: batches by count and tokens, retries with growing pauses, answers put in order.

    Requests that come too soon (429) are repeated until they are answered; other failures ``attempts`` times.
    """

    url: str
    model: str
    api_key: str = ""
    max_batch: int = 0
    attempts: int = 8
    pause: float = 1.0
    longest_pause: float = 30.0
    sleep: Callable[[float], None] = time.sleep
    send: Callable = post

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [v for part in in_batches(texts, self.max_batch or MAX_TEXTS) for v in self._batch(part)]

    def _batch(self, texts: list[str]) -> list[list[float]]:
        pause, failures = self.pause, 0
        while True:
            try:
                answer = self.send(join_url(self.url, "/embeddings"), {"model": self.model, "input": texts}, self.api_key, 120)
                rows = sorted(answer["data"], key=lambda r: r["index"])
                if len(rows) != len(texts):
                    raise ValueError(f"{len(rows)} vectors for {len(texts)} texts")
                return [r["embedding"] for r in rows]
            except Exception as e:
                limited = isinstance(e, HttpError) and e.status == 429
                failures += not limited
                if not retryable(e) or failures >= self.attempts:
                    raise
                self.sleep(max(pause, getattr(e, "retry_after", 0.0)))
                pause = min(2 * pause, self.longest_pause)


@dataclass
class LocalEmbedder:
    """An embeddings service that takes one text at a time."""

    model: str
    url: str = "http://localhost:11434"
    send: Callable = post

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [self.send(f"{self.url.rstrip('/')}/api/embeddings", {"model": self.model, "prompt": t}, "", 120)["embedding"] for t in texts]


def embed_text(embed: Embedder | None, text: str) -> list[float]:
    if embed is None:
        raise ValueError("there is no embedder")
    vectors = embed([text])
    if not vectors or not len(vectors[0]):
        raise ValueError("no vector came back")
    return list(vectors[0])


def embed_chunks(chunks: DataFrame, embed: Embedder, text: str = "text", tolerant: bool = False, most: int = MAX_TEXTS) -> DataFrame:
    """``chunks`` with embedding: each task sends its texts in batches as it reads them.

    ``tolerant``: a batch of up to ``most`` texts that fails doesn't fail the job; its chunks get no vector but an error,
    and its first one counts it (batch_failed is 1, else 0).
    """
    extra = ["embedding", "error", "batch_failed"] if tolerant else ["embedding"]
    names = [c for c in chunks.columns if c not in extra]
    at = names.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            if not tolerant:
                vectors = [np.asarray(v, dtype=np.float32) for v in embed(texts)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*names, "embedding"])
                continue
            vectors, errors, failed = [], [], []
            for part in in_batches(texts, most):
                try:
                    vectors += [np.asarray(v, dtype=np.float32) for v in embed(part)]
                    errors += [None] * len(part)
                    failed += [0] * len(part)
                except Exception as e:
                    vectors += [None] * len(part)
                    errors += [f"{type(e).__name__}: {e}"] * len(part)
                    failed += [1, *[0] * (len(part) - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string()), pa.array(failed, pa.int32())], names=[*names, *extra])

    own = chunks.select(*names)
    kinds = {"embedding": ArrayType(FloatType()), "error": StringType(), "batch_failed": IntegerType()}
    return mapped(own, run, StructType([*own.schema.fields, *[StructField(c, kinds[c]) for c in extra]]))


def ask(rows: DataFrame, complete: Callable[[str], str], prompt: str = "prompt") -> DataFrame:
    """``rows`` with answer, and error where there is none: each task asks for its rows; a failure is its row's."""
    at = rows.columns.index(prompt)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            answers, errors = [], []
            for text in b.column(at).to_pylist():
                try:
                    answers.append(complete(text))
                    errors.append(None)
                except Exception as e:
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=[*b.schema.names, "answer", "error"])

    return mapped(rows, run, StructType([*rows.schema.fields, StructField("answer", StringType()), StructField("error", StringType())]))


@dataclass
class HttpReranker:
    """A cross-encoder service: rows in the order of its scores; indexes that aren't rows are left out."""

    url: str
    model: str
    api_key: str = ""
    send: Callable = post

    def __call__(self, query: str, rows: list[dict]) -> list[dict]:
        if not rows:
            return rows
        answer = self.send(self.url, {"model": self.model, "query": query, "documents": [r["text"] for r in rows]}, self.api_key, 30)
        scored = [{**rows[x["index"]], "score": float(x["relevance_score"])} for x in answer["results"] if 0 <= x["index"] < len(rows)]
        return sorted(scored, key=lambda r: -r["score"])


@dataclass
class HttpEvaluator:
    """A judging service; a label that isn't known is UNCERTAIN."""

    url: str
    model: str = ""
    api_key: str = ""
    send: Callable = post

    def __call__(self, query: str, rows: list[dict]) -> str:
        answer = self.send(self.url, {"model": self.model, "query": query, "documents": [r["text"] for r in rows]}, self.api_key, 20)
        label = str(answer.get("quality", "")).strip().upper()
        return label if label in (HIGH, LOW) else UNCERTAIN


def heuristic_evaluator(query: str, rows: list[dict]) -> str:
    from larkspur.operators.corrective import quality_label

    scores = [r["score"] for r in rows]
    return quality_label(max(scores, default=0.0), sum(scores[:3]) / max(1, len(scores[:3])), len(scores))


@dataclass
class HttpWebSearch:
    """A search service: rows named web-0, web-1 ..., whose document is the page's address."""

    url: str
    api_key: str = ""
    send: Callable = post

    def __call__(self, query: str, k: int) -> list[dict]:
        answer = self.send(self.url, {"query": query, "top_k": k}, self.api_key, 20)
        found = answer.get("results") or []
        return [{"id": f"web-{i}", "document_id": r.get("url", ""), "text": r.get("content") or r.get("title") or "", "score": float(r.get("score") or 0.0)} for i, r in enumerate(found[:k])]


@dataclass
class HttpRewriter:
    """A rewriting service: at most ``most`` queries, each once."""

    url: str
    model: str = ""
    api_key: str = ""
    send: Callable = post

    def __call__(self, query: str, most: int = 3) -> list[str]:
        answer = self.send(self.url, {"model": self.model, "query": query, "max_queries": most}, self.api_key, 20)
        return list(dict.fromkeys(q.strip() for q in answer.get("queries") or [] if q.strip()))[: most if most > 0 else 3]


def rule_rewriter(query: str, most: int = 3, rules: RewriteRules | None = None) -> list[str]:
    """What rules (the built-in ones) make of one query: the plain form of rewrites()."""
    from larkspur.operators.rewrite import DERIVED, RewriteRules

    rules, q = rules or RewriteRules(), query.strip()
    out = [q.replace(a, b) for a, b in rules.terms if a in q and a + DERIVED not in q]
    out += [f"{q} {b}" for a, b in rules.synonyms if a in q]
    out += [q.replace(a, b) for a, bs in rules.hyponyms if a in q for b in bs]
    return list(dict.fromkeys(x for x in out if x))[: most if most > 0 else 3]


@dataclass
class ChatClient:
    """A chat-completions service."""

    url: str
    model: str
    api_key: str = ""
    temperature: float = 0.7
    max_tokens: int = 2000
    send: Callable = field(default=post)

    def complete(self, prompt: str, system: str = "") -> str:
        messages = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": prompt}]
        answer = self.send(join_url(self.url, "/chat/completions"), {"model": self.model, "messages": messages, "temperature": self.temperature, "max_tokens": self.max_tokens}, self.api_key, None)
        if not answer.get("choices"):
            raise ValueError("the model gave no answer")
        return answer["choices"][0]["message"]["content"]

    def complete_json(self, prompt: str, system: str = "") -> dict:
        text = self.complete(prompt, system).strip()
        if text.startswith("```"):
            text = text.removeprefix("```json").removeprefix("```").removesuffix("```").strip()
        return json.loads(text)
