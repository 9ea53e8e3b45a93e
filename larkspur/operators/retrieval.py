"""Searches made of the operators: keyword, hybrid, many queries at once, fallbacks, and the whole pipeline.

All take a batch of queries, so a hundred queries are one plan. The pipeline steps that call models (rewriting, reranking,
judging, web search) are functions given by the caller; they see the few rows of result lists, never the collection.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import tokenize
from larkspur.operators import bm25, corrective, fusion, listing, rewrite, vector_search
from larkspur.operators.inverted import KeywordIndex

RERANK_WIDER = 3


def wide(k: int) -> int:
    """Candidates that each retriever of a hybrid search gives."""
    return max(10 * k, 20)


def keyword_pool(k: int) -> int:
    """Candidates of a keyword search in ``raw_like`` mode."""
    return max(10 * k, 50)


def keyword_search(chunks: DataFrame, query: str, k: int = 5, mode: str = "any_term", scope: str = "candidates") -> DataFrame:
    """BM25 of one query: query_id (0), id, score, rank.

    ``mode``: which chunks are candidates; ``raw_like`` keeps only the first of them by id, as many as keyword_pool().
    ``scope``: whose statistics weigh the terms, the ``candidates``' or the whole ``corpus``'s.
    """
    queries = chunks.sparkSession.createDataFrame([(0, query)], "query_id long, query string")
    found = listing.keyword_candidates(chunks, query, mode)
    if mode == "raw_like":
        found = found.orderBy("id").limit(keyword_pool(k))
    if scope == "corpus":
        scores = bm25.bm25_scores(chunks, queries).join(found.select("id"), "id", "left_semi")
        return bm25.ranked(scores, k)
    return bm25.bm25_search(found, queries, k)


def hybrid_search(chunks: DataFrame, queries: DataFrame, k: int = 5, threshold: float | None = 0.5, index: KeywordIndex | None = None) -> DataFrame:
    """Reciprocal rank fusion of vector and BM25 search over the chunks (id, text, embedding) that have a vector.

    ``queries``: query_id, query, query_vec. The threshold is the vector list's; query_id, id, score, rank. ``index``: of
    just these chunks, whose texts aren't read then.
    """
    own, words = listing.embedded(chunks), queries.select("query_id", "query")
    by_vector = vector_search.vector_search(own, queries, wide(k), threshold)
    by_words = bm25.bm25_search(own, words, wide(k)) if index is None else index.search(words, wide(k))
    return fusion.reciprocal_rank_fusion(by_vector, by_words, k=k)


def multi_query_bm25(chunks: DataFrame | KeywordIndex, variants: DataFrame, k: int = 5) -> DataFrame:
    """``variants``: query_id, variant, query. All in one search; a chunk's best raw score over a query's variants counts.

    A chunk among a query's ``k`` best is among those of the variant that it scores best by, so an index gives only these.
    """
    named = variants.select(F.struct("query_id", "variant").alias("query_id"), "query")
    found = chunks.search(named, k) if isinstance(chunks, KeywordIndex) else bm25.bm25_scores(chunks, named)
    scores = found.select("query_id.query_id", "id", "score")
    return bm25.ranked(scores.groupBy("query_id", "id").agg(F.max("score").alias("score")), k)


def multi_query_vectors(chunks: DataFrame, variants: DataFrame, k: int = 5, most: int = 16, by_rank: bool = False) -> DataFrame:
    """``variants``: query_id (a whole number), variant (from 0, below ``most``), query_vec. All in one search.

    A chunk's best score over a query's variants counts, or, ``by_rank``, the reciprocal ranks of its variants' lists. A
    variant that isn't below ``most`` is an error.
    """
    wrong = F.raise_error(F.concat(F.lit(f"a variant isn't from 0 to {most - 1}: "), F.col("variant").cast("string")))
    number = F.when(F.col("variant").between(0, most - 1), F.col("query_id") * most + F.col("variant")).otherwise(wrong.cast("long"))
    named = variants.select(number.alias("query_id"), "query_vec")
    found = vector_search.vector_search(chunks, named, wide(k)).withColumn("query_id", F.floor(F.col("query_id") / most).cast("long"))
    if by_rank:
        return fusion.reciprocal_rank_fusion(found, found.limit(0), k=k)
    return bm25.ranked(found.groupBy("query_id", "id").agg(F.max("score").alias("score")), k)


def with_fallback(hits: DataFrame, other: DataFrame, k: int = 5, when: tuple[str, ...] = (corrective.LOW,)) -> DataFrame:
    """Lists judged as one of ``when`` united with ``other`` results (query_id, id, score); the rest as they are."""
    weak = corrective.judged(hits).filter(F.col("quality").isin(*when)).select("query_id")
    missing = other.select("query_id").distinct().join(hits.select("query_id").distinct(), "query_id", "left_anti")
    more = other.join(weak.unionByName(missing), "query_id", "left_semi")
    both = hits.select("query_id", "id", "score").unionByName(more.select("query_id", "id", "score"))
    return bm25.ranked(both.groupBy("query_id", "id").agg(F.max("score").alias("score")), k)


@dataclass(frozen=True)
class SearchOptions:
    """How to search; None is "as the retriever says", so that 0 can be asked for."""

    top_k: int = 5
    threshold: float | None = None
    document_id: object = None
    mode: str = "any_term"

    def settled(self, retriever: Retriever) -> SearchOptions:
        return replace(self, top_k=self.top_k if self.top_k > 0 else 5, threshold=retriever.threshold if self.threshold is None else self.threshold)


@dataclass
class Retriever:
    """One query through the pipeline: rewrite, search each variant, rerank, judge, correct.

    ``embed``: texts to vectors; ``rewriter``: (query, most) to queries; ``reranker``: (query, rows) to rows;
    ``evaluator``: (query, rows) to a label; ``web_search``: (query, k) to rows. Rows are dictionaries of id, document_id,
    text and score. A step that fails leaves what it was given, as does an embedding that fails: keywords alone then.
    ``index``: of the chunks, for keyword searches among all of them; their texts aren't read then.
    """

    chunks: DataFrame
    embed: Callable | None = None
    rewriter: Callable | None = None
    reranker: Callable | None = None
    evaluator: Callable | None = None
    web_search: Callable | None = None
    threshold: float = 0.5
    rewrite_limit: int = 3
    index: KeywordIndex | None = None

    def _ranked(self, query: str, options: SearchOptions, k: int) -> DataFrame:
        own = self.chunks if options.document_id is None else self.chunks.filter(F.col("document_id") == F.lit(options.document_id))
        if self.embed is None and self.index is not None and options.document_id is None and options.mode == "any_term":
            terms = [r.t for r in self._one(query).select(F.explode(tokenize(F.col("query"))).alias("t")).collect()]  # one query's words
            return self.index.keyword_search(terms, k)
        if self.embed is None:
            return keyword_search(own, query, k, options.mode) if options.document_id is None else bm25.bm25_search(own, self._one(query), k)
        own = listing.embedded(own)
        try:
            vector = [float(x) for x in self.embed([query])[0]]
        except Exception:  # a model out of reach: words remain
            return bm25.bm25_search(own, self._one(query), k)
        queries = self.chunks.sparkSession.createDataFrame([(0, query, vector)], "query_id long, query string, query_vec array<double>")
        return hybrid_search(own, queries, k, options.threshold)

    def _one(self, query: str) -> DataFrame:
        return self.chunks.sparkSession.createDataFrame([(0, query)], "query_id long, query string")

    def _rows(self, query: str, options: SearchOptions) -> list[dict]:
        k = options.top_k * (RERANK_WIDER if self.reranker else 1)
        columns = [c for c in ("id", "document_id", "chunk_index", "text") if c in self.chunks.columns]
        found = self._ranked(query, options, k).join(self.chunks.select(*columns), "id")
        rows = [r.asDict() for r in found.select(*columns, "score").orderBy(F.desc("score"), "id").collect()]  # k rows at most
        if self.reranker:
            try:
                rows = self.reranker(query, rows)
            except Exception:  # the first order stays
                pass
        return rows[: options.top_k]

    def _searched(self, queries: list[str], options: SearchOptions) -> list[dict]:
        errors, lists = [], []
        for q in queries:
            try:
                lists.append(self._rows(q, options))
            except Exception as e:
                errors.append(e)
        if errors and not any(lists):
            raise errors[0]
        return best_rows([r for rows in lists for r in rows], options.top_k)

    def _variants(self, query: str) -> list[str]:
        if self.rewriter is None:
            return []
        try:
            return [q for q in self.rewriter(query, self.rewrite_limit) if q]
        except Exception:  # the query itself remains
            return []

    def search(self, query: str, options: SearchOptions = SearchOptions()) -> list[dict]:
        """Rows of the best chunks, best first."""
        query, options = query.strip(), options.settled(self)
        rows = self._searched(list(dict.fromkeys([query, *self._variants(query)])), options)
        if self.evaluator is None:
            return rows
        try:
            label = self.evaluator(query, rows)
            if label == corrective.LOW and self.web_search:
                return best_rows(rows + self.web_search(query, options.top_k), options.top_k)
            if label == corrective.UNCERTAIN:
                again = self._variants(query) or [query + rewrite.MORE]
                return best_rows(rows + self._searched(again, options), options.top_k)
        except Exception:  # what was found stays
            pass
        return rows


def best_rows(rows: list[dict], k: int) -> list[dict]:
    """Each chunk once with its best score (document and text name it where it has no id), best first, at most ``k``."""
    best: dict = {}
    for r in rows:
        key = r.get("id") if r.get("id") not in (None, "") else (r.get("document_id"), r.get("text"))
        if key not in best or r["score"] > best[key]["score"]:
            best[key] = r
    return sorted(best.values(), key=lambda r: (-r["score"], str(r.get("id"))))[:k]
