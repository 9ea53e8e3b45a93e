"""Queries of retrieval: BM25, vectors, fusion, rewriting, judging, reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import vectors as v
from larkspur.functions.text import tokenize
from larkspur.operators import bm25, corrective, fusion, listing, retrieval, rewrite, vector_search
from larkspur.operators.bounded import sent
from larkspur.plans import corpus
from larkspur.plans.tables import table
from larkspur.plans.text_queries import TOKENS
from larkspur.sources.shared import written

K = 5
WIDE = retrieval.wide(K)
THRESHOLD = 0.2
#: The document that scoped searches are about.
DOCUMENT = 5


def bm25_search(spark: SparkSession, sf: str) -> DataFrame:
    """By the collection's inverted index: its texts are read when that is written, not by searches."""
    return corpus.text_index(spark, sf).search(corpus.text_queries(spark, sf), K)


def bm25_doc_scoped(spark: SparkSession, sf: str) -> DataFrame:
    """Among the chunks of one document only (DOCUMENT, a conversation): statistics are of those."""
    scoped = corpus.turns(spark, sf).filter(F.col("document_id") == DOCUMENT)
    return bm25.bm25_search(scoped, _turn_queries(spark, sf), K)


def _turn_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The first turns of conversations as queries."""
    return corpus.turns(spark, sf).filter((F.col("chunk_index") == 0) & (F.col("document_id") % corpus.EVERY == 0)).select(F.col("document_id").alias("query_id"), F.col("text").alias("query"))


def _variants(spark: SparkSession, sf: str) -> DataFrame:
    """Each query twice: whole, and its first sentence's words left out."""
    q = corpus.text_queries(spark, sf)
    return q.select("query_id", F.posexplode(F.array(F.col("query"), F.regexp_replace("query", r"^[^.]*\.", ""))).alias("variant", "query"))


def bm25_multi_query(spark: SparkSession, sf: str) -> DataFrame:
    """Variants of a query searched at once; of each chunk the best raw score counts."""
    return retrieval.multi_query_bm25(corpus.text_index(spark, sf), _variants(spark, sf), K)


def keyword_any_term_search(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of the chunks that have one of the words, all by the index."""
    return corpus.text_index(spark, sf).keyword_search(["where", "the", "contract", "ends"], K)


def keyword_prefilter(spark: SparkSession, sf: str) -> DataFrame:
    return listing.keyword_candidates(corpus.texts(spark, sf), "And The", "phrase").select("id")


def keyword_search(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of the candidates alone: chunks that hold the phrase."""
    return retrieval.keyword_search(corpus.texts(spark, sf), "and the", K, mode="phrase")


def keyword_any_term(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates that have one of the words."""
    return corpus.text_index(spark, sf).candidates(["where", "the", "contract", "ends"])


def keyword_raw_like(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates that match a LIKE pattern."""
    return listing.keyword_candidates(corpus.texts(spark, sf), "The_%and", "raw_like").select("id")


def phrase_by_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that hold the beginning of a benchmark item: only files whose filters may have it are read."""
    asked = table(spark, sf, "benchmark").filter("item_id = 0").select(F.substring("text", 1, 60).alias("t")).first().t
    texts, filters = corpus.filtered_texts(spark, sf)
    return filters.containing(texts, asked).select("id")


def like_by_filters(spark: SparkSession, sf: str) -> DataFrame:
    texts, filters = corpus.filtered_texts(spark, sf)
    return filters.like(texts, "idiot%scum_").select("id")


def cosine_scores(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs from a similarity on."""
    return vector_search.similar_pairs(corpus.chunks(spark, sf), corpus.vector_queries(spark, sf), THRESHOLD)


def _vector_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Each query twice: its vector, and the vector with every second number left out."""
    half = F.transform("query_vec", lambda x, i: F.when(i % 2 == 0, x).otherwise(F.lit(0).cast("float")))
    return corpus.vector_queries(spark, sf).select("query_id", F.posexplode(F.array("query_vec", half)).alias("variant", "query_vec"))


def vector_multi_query(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.multi_query_vectors(corpus.chunks(spark, sf), _vector_variants(spark, sf), K)


def vector_multi_query_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """The variants' lists merged by their ranks."""
    return retrieval.multi_query_vectors(corpus.chunks(spark, sf), _vector_variants(spark, sf), K, by_rank=True)


def vector_search_(spark: SparkSession, sf: str) -> DataFrame:
    return vector_search.vector_search(corpus.chunks(spark, sf), corpus.vector_queries(spark, sf), K, THRESHOLD)


def vector_topk_dot(spark: SparkSession, sf: str) -> DataFrame:
    return vector_search.vector_search(corpus.chunks(spark, sf), corpus.vector_queries(spark, sf), K, cosines=False)


def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    unit = v.l2_normalized(F.transform("embedding", lambda x: x * 3))
    return corpus.chunks(spark, sf).select("id", F.round(v.norm(unit), 9).alias("norm"), F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.hybrid_search(corpus.hybrid_chunks(spark, sf), corpus.hybrid_queries(spark, sf), K, THRESHOLD, corpus.hybrid_index(spark, sf))


def hybrid_doc_scoped(spark: SparkSession, sf: str) -> DataFrame:
    """Among the chunks of one document: here a label's vectors, with the texts of their numbers."""
    labels = corpus.chunks(spark, sf).filter(F.col("label") == DOCUMENT).select("id")
    return retrieval.hybrid_search(corpus.hybrid_chunks(spark, sf).join(labels, "id", "left_semi"), corpus.hybrid_queries(spark, sf), K, THRESHOLD)


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Two orders of the same vectors' numbers, fused."""
    q = corpus.vector_queries(spark, sf)
    a = vector_search.vector_search(corpus.chunks(spark, sf), q, WIDE)
    b = a.withColumn("rank", F.lit(WIDE + 1) - F.col("rank"))
    return fusion.reciprocal_rank_fusion(a, b, k=K)


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as hits: the conversation is the document, and the text's length is the score."""
    return table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("document_id"), "text", (F.length("text") % 10 / 10.0).alias("score"))


def dedupe_keep_best(spark: SparkSession, sf: str) -> DataFrame:
    hits = _hits(spark, sf)
    again = hits.withColumn("score", F.col("score") + F.when(F.col("id") % 2 == 0, 0.25).otherwise(-0.25))
    return fusion.merged(hits, again).select("id", F.round("score", 6).alias("score"))


def dedupe_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.first_of_text(_hits(spark, sf)).select("id", "document_id", F.round("score", 6).alias("score"))


#: One word replaced, one added, one put for its kinds.
RULES = rewrite.RewriteRules((("the", "a"),), (("and", "also"),), (("is", ("was", "be")),))


def rewrite_lateral(spark: SparkSession, sf: str) -> DataFrame:
    """The same by the table function, in SQL."""
    from larkspur.sources import web

    web.register(spark, RULES, "rewritten_by_rules")
    turns = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    return spark.sql("SELECT query_id, variant, rewritten AS query FROM {turns}, LATERAL rewritten_by_rules(query, 4)", turns=turns)


def second_tries(spark: SparkSession, sf: str) -> DataFrame:
    """By what turns are searched again where their results are uncertain."""
    turns = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.posexplode(rewrite.second_tries(F.col("text"), RULES, 4)).alias("variant", "query"))
    return turns.select("query_id", F.col("variant").cast("long").alias("variant"), "query")


def embedding_fails(spark: SparkSession, sf: str) -> DataFrame:
    """A search whose query gets no vector: keywords alone, among the chunks that have one."""

    def broken(texts: list[str]) -> list:
        raise OSError("no model")

    retriever = retrieval.Retriever(corpus.hybrid_chunks(spark, sf), embed=broken)
    return retriever._ranked("where the contract ends", retrieval.SearchOptions(top_k=K).settled(retriever), K)


def rewrite_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules over the words of all turns."""
    turns = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    return rewrite.expand_queries(turns, RULES, 4)


def quality_label(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of cosine scores of each query but itself, judged."""
    hits = vector_search.vector_search(corpus.chunks(spark, sf), corpus.vector_queries(spark, sf), K)
    return corrective.judged(hits, corpus.vector_queries(spark, sf)).select("query_id", F.round("top_score", 6).alias("top_score"), F.round("mean_score", 6).alias("mean_score"), "n_hits", "quality")


def corrective_union(spark: SparkSession, sf: str) -> DataFrame:
    """Lists that aren't HIGH get other results beside theirs: here those of the next vector's query."""
    hits = vector_search.vector_search(corpus.chunks(spark, sf), corpus.vector_queries(spark, sf), K)
    other = corpus.vector_queries(spark, sf).select("query_id", (F.col("query_id") + 1).alias("id"), F.lit(0.5).alias("score"), F.lit(1).cast("long").alias("rank"))
    return retrieval.with_fallback(hits, other, K, when=(corrective.LOW, corrective.UNCERTAIN))


def rerank(spark: SparkSession, sf: str) -> DataFrame:
    """BM25's wide pool put in the order of another score: the share of the query's words that the text has."""
    pool = written(corpus.text_index(spark, sf).search(corpus.text_queries(spark, sf), retrieval.RERANK_WIDER * K), "pool")
    # texts that no list has are only read
    full = corpus.undealt_texts(spark, sf).select("id", "text").join(sent(pool), "id").join(corpus.text_queries(spark, sf), "query_id")
    share = F.size(F.array_intersect(tokenize(F.col("query")), tokenize(F.col("text")))) / F.greatest(F.size(F.array_distinct(tokenize(F.col("query")))), F.lit(1))
    return bm25.ranked(full.withColumn("score", share), K)


def hits_enriched(spark: SparkSession, sf: str) -> DataFrame:
    hits = vector_search.vector_search(corpus.chunks(spark, sf), corpus.vector_queries(spark, sf), K).withColumnRenamed("id", "document_id")
    return listing.with_document(hits, corpus.live_documents(spark, sf)).select("query_id", "document_id", "rank", "document_name", "file_path")


def hits_json(spark: SparkSession, sf: str) -> DataFrame:
    from larkspur.plans.sinks import hits_as_json

    hits = vector_search.vector_search(corpus.chunks(spark, sf), corpus.vector_queries(spark, sf), K).withColumnRenamed("id", "document_id")
    return hits_as_json(listing.with_document(hits, corpus.live_documents(spark, sf)).select("query_id", "rank", "document_id", "document_name", "file_path"))


QUERIES = {f.__name__.rstrip("_"): f for f in (bm25_search, phrase_by_filters, like_by_filters, keyword_any_term_search, bm25_doc_scoped, bm25_multi_query, keyword_prefilter, keyword_any_term, keyword_raw_like, keyword_search, cosine_scores, vector_multi_query, vector_multi_query_ranks, vector_search_, vector_topk_dot, l2_normalize, hybrid_search, hybrid_doc_scoped, rrf_fusion, dedupe_keep_best, dedupe_first_wins, rewrite_rules, rewrite_lateral, second_tries, embedding_fails, quality_label, corrective_union, rerank, hits_enriched, hits_json)}


def bm25_ctes(texts: str, queries: str, name: str = "") -> str:
    """CTEs ending in ``scored``: query_id, id, score. ``texts``: id, text; ``queries``: query_id, query."""
    q = TOKENS.replace("(text,", "(query,")
    return f"""tx{name} AS ({texts}), qs{name} AS ({queries}),
 tok{name} AS (SELECT id, {TOKENS} ts FROM tx{name}), st{name} AS (SELECT count(*) n, avg(len(ts)) avgdl FROM tok{name}),
 tf{name} AS (SELECT id, term, count(*) tf, max(dl) dl FROM (SELECT id, len(ts) dl, unnest(ts) term FROM tok{name}) GROUP BY id, term),
 df{name} AS (SELECT term, count(*) df FROM tf{name} GROUP BY term),
 qt{name} AS (SELECT query_id, term, count(*) qtf FROM (SELECT query_id, unnest({q}) term FROM qs{name}) GROUP BY query_id, term),
 scored{name} AS (SELECT query_id, id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf{name} JOIN df{name} USING (term) JOIN qt{name} USING (term), st{name} GROUP BY query_id, id)"""


def top_rows(table_name: str, k: int, least: str = "score > 0", name: str = "query_id") -> str:
    return f"""SELECT {name}, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY {name} ORDER BY score DESC, id) AS rank FROM (SELECT {name}, id, round(score, 9) AS score FROM {table_name}) WHERE {least}) WHERE rank <= {k}"""


TEXTS = "SELECT doc_id AS id, text FROM documents"
TEXT_QUERIES = "SELECT item_id AS query_id, text AS query FROM benchmark WHERE item_id % 20 = 0"
COSINES = "cos AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0)"
DOTS = "cos AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0)"
VARIANTS = """var AS (SELECT q.vec_id * 16 + v AS variant_id, e.vec_id AS id, list_cosine_similarity(CASE v WHEN 0 THEN q.embedding::DOUBLE[] ELSE list_transform(q.embedding::DOUBLE[], lambda x, i: CASE WHEN i % 2 = 1 THEN x ELSE 0 END) END, e.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings e, (VALUES (0), (1)) t(v) WHERE q.vec_id % 20 = 0)"""
_HYBRID_TEXTS = "SELECT d.doc_id AS id, d.text FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id"
_HYBRID_QUERIES = "SELECT item_id AS query_id, b.text AS query FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id WHERE item_id % 20 = 0"


def _hybrid(where: str = "") -> str:
    return f"""WITH {bm25_ctes(_HYBRID_TEXTS + where.format('d.doc_id'), _HYBRID_QUERIES)}, {COSINES},
 vec AS ({top_rows(f"(SELECT * FROM cos WHERE query_id IN (SELECT query_id FROM qs) AND id IN (SELECT id FROM tx))", WIDE, f"score > 0 AND score >= {THRESHOLD}")}),
 kw AS ({top_rows("scored", WIDE)}),
 fused AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT * FROM vec UNION ALL SELECT * FROM kw) GROUP BY query_id, id)
 {top_rows("fused", K)}"""


_HITS = "hits AS (SELECT conv_id * 1000 + turn AS id, conv_id AS document_id, text, length(text) % 10 / 10.0 AS score FROM conversations)"

SQL = {
    "bm25_search": f"WITH {bm25_ctes(TEXTS, TEXT_QUERIES)} {top_rows('scored', K)}",
    "bm25_doc_scoped": f"WITH {bm25_ctes(f'SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE conv_id = {DOCUMENT}', 'SELECT conv_id AS query_id, text AS query FROM conversations WHERE turn = 0 AND conv_id % 20 = 0')} {top_rows('scored', K)}",
    "phrase_by_filters": "SELECT doc_id AS id FROM documents WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), (SELECT translate(substr(text, 1, 60), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark WHERE item_id = 0))",
    "like_by_filters": "SELECT doc_id AS id FROM documents WHERE translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%idiot%scum_%'",
    "keyword_any_term_search": f"""WITH {bm25_ctes(TEXTS + f" WHERE list_has_any({TOKENS}, ['where', 'the', 'contract', 'ends'])", "SELECT 0::BIGINT AS query_id, 'where the contract ends' AS query")} {top_rows('scored', K)}""",
    "keyword_any_term": f"SELECT doc_id AS id FROM documents WHERE list_has_any({TOKENS}, ['where', 'the', 'contract', 'ends'])",
    "keyword_raw_like": "SELECT doc_id AS id FROM documents WHERE translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%the_%and%'",
    "vector_multi_query": f"WITH {VARIANTS}, wide AS ({top_rows('var', WIDE, name='variant_id')}), best AS (SELECT variant_id // 16 AS query_id, id, max(score) AS score FROM wide GROUP BY 1, 2) {top_rows('best', K)}",
    "vector_multi_query_ranks": f"WITH {VARIANTS}, wide AS ({top_rows('var', WIDE, name='variant_id')}), fused AS (SELECT variant_id // 16 AS query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM wide GROUP BY 1, 2) {top_rows('fused', K)}",
    "bm25_multi_query": f"""WITH {bm25_ctes(TEXTS, TEXT_QUERIES, 'a')}, {bm25_ctes(TEXTS, f"SELECT query_id, regexp_replace(query, '^[^.]*[.]', '') AS query FROM ({TEXT_QUERIES})", 'b')},
 best AS (SELECT query_id, id, max(score) AS score FROM (SELECT * FROM scoreda UNION ALL SELECT * FROM scoredb) GROUP BY query_id, id) {top_rows('best', K)}""",
    "keyword_prefilter": "SELECT doc_id AS id FROM documents WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'and the')",
    "keyword_search": f"""WITH {bm25_ctes(TEXTS + " WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'and the')", "SELECT 0::BIGINT AS query_id, 'and the' AS query")} {top_rows('scored', K)}""",
    "cosine_scores": f"WITH {COSINES} SELECT query_id, id, round(score, 9) AS score FROM cos WHERE round(score, 9) >= {THRESHOLD}",
    "vector_search": f"WITH {COSINES} {top_rows('cos', K, f'score > 0 AND score >= {THRESHOLD}')}",
    "vector_topk_dot": f"WITH {DOTS} {top_rows('cos', K)}",
    "l2_normalize": "WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE * 3) v FROM embeddings), u AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) u FROM e) SELECT id, round(sqrt(list_dot_product(u, u)), 9) AS norm, round(list_sum(u), 6) AS total FROM u",
    "hybrid_search": _hybrid(),
    "hybrid_doc_scoped": _hybrid(f" WHERE label = {DOCUMENT}"),
    "rrf_fusion": f"WITH {COSINES}, a AS ({top_rows('cos', WIDE)}), fused AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT query_id, id, rank FROM a UNION ALL SELECT query_id, id, {WIDE + 1} - rank FROM a) GROUP BY query_id, id) {top_rows('fused', K)}",
    "dedupe_keep_best": f"WITH {_HITS} SELECT id, round(max(s), 6)::DOUBLE AS score FROM (SELECT id, score::DOUBLE s FROM hits UNION ALL SELECT id, score::DOUBLE + CASE WHEN id % 2 = 0 THEN 0.25 ELSE -0.25 END FROM hits) GROUP BY id",
    "dedupe_first_wins": f"WITH {_HITS} SELECT id, document_id, round(score, 6)::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY document_id, text ORDER BY score DESC, id) n FROM hits) WHERE n = 1",
    "rewrite_rules": """WITH q AS (SELECT conv_id * 1000 + turn AS query_id, trim(text, ' ' || chr(10)) AS query FROM conversations),
 r AS (SELECT query_id, 0 o, query FROM q UNION ALL SELECT query_id, 1, replace(query, 'the', 'a') FROM q WHERE contains(query, 'the') AND NOT contains(query, 'the化') UNION ALL SELECT query_id, 2, query || ' also' FROM q WHERE contains(query, 'and')
  UNION ALL SELECT query_id, 3, replace(query, 'is', 'was') FROM q WHERE contains(query, 'is') UNION ALL SELECT query_id, 4, replace(query, 'is', 'be') FROM q WHERE contains(query, 'is')),
 u AS (SELECT query_id, query, min(o) o FROM r WHERE query <> '' GROUP BY query_id, query)
 SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY o) - 1 AS INTEGER) AS variant, query FROM u""",
    "quality_label": f"""WITH {COSINES}, hits AS ({top_rows('cos', K)}), f AS (SELECT query_id, max(score) top_score, avg(CASE WHEN rank <= 3 THEN score END) mean_score, count(*) n_hits FROM hits GROUP BY query_id)
 SELECT query_id, round(top_score, 6) AS top_score, round(mean_score, 6) AS mean_score, n_hits, CASE WHEN top_score >= 0.6 AND mean_score >= 0.6 AND n_hits >= 2 THEN 'HIGH' WHEN top_score <= 0.1 AND mean_score <= 0.15 THEN 'LOW' ELSE 'UNCERTAIN' END AS quality FROM f""",
    "corrective_union": f"""WITH {COSINES}, hits AS ({top_rows('cos', K)}), f AS (SELECT query_id, max(score) top_score, avg(CASE WHEN rank <= 3 THEN score END) mean_score, count(*) n FROM hits GROUP BY query_id),
 weak AS (SELECT query_id FROM f WHERE NOT (top_score >= 0.6 AND mean_score >= 0.6 AND n >= 2)),
 united AS (SELECT query_id, id, max(score) AS score FROM (SELECT query_id, id, score FROM hits UNION ALL SELECT query_id, query_id + 1, 0.5 FROM weak) GROUP BY query_id, id) {top_rows("united", K)}""",
    "rerank": f"""WITH {bm25_ctes(TEXTS, TEXT_QUERIES)}, pool AS ({top_rows('scored', 15)}),
 other AS (SELECT p.query_id, p.id, len(list_intersect(list_distinct(q.ts), list_distinct(t.ts))) / greatest(len(list_distinct(q.ts)), 1) AS score FROM pool p JOIN tok t USING (id) JOIN (SELECT query_id, {TOKENS.replace("(text,", "(query,")} ts FROM qs) q USING (query_id)) {top_rows('other', K)}""",
    "hits_enriched": f"""WITH {COSINES}, {corpus.DOCUMENTS}, hits AS ({top_rows('cos', K)}) SELECT query_id, h.id AS document_id, rank, coalesce(name, '') AS document_name, coalesce(file_path, '') AS file_path FROM hits h LEFT JOIN (SELECT * FROM docs WHERE id % 7 <> 0) d ON d.id = h.id""",
    "hits_json": f"""WITH {COSINES}, {corpus.DOCUMENTS}, hits AS ({top_rows('cos', K)}), e AS (SELECT query_id, rank, h.id AS document_id, coalesce(name, '') AS document_name, coalesce(file_path, '') AS file_path FROM hits h LEFT JOIN (SELECT * FROM docs WHERE id % 7 <> 0) d ON d.id = h.id)
 SELECT query_id, count(*) AS count, '[' || string_agg('{{"rank":' || rank || ',"document_id":' || document_id || ',"document_name":"' || document_name || '","file_path":"' || file_path || '"}}', ',' ORDER BY rank) || ']' AS results FROM e GROUP BY query_id""",
}

SQL["rewrite_lateral"] = SQL["rewrite_rules"]
SQL["embedding_fails"] = f"WITH {bm25_ctes(_HYBRID_TEXTS, "SELECT 0::BIGINT AS query_id, 'where the contract ends' AS query")} {top_rows('scored', K)}"
SQL["second_tries"] = """WITH q AS (SELECT conv_id * 1000 + turn AS query_id, trim(text, ' ' || chr(10)) AS query FROM conversations),
 r AS (SELECT query_id, 1 o, replace(query, 'the', 'a') query FROM q WHERE contains(query, 'the') AND NOT contains(query, 'the化') UNION ALL SELECT query_id, 2, query || ' also' FROM q WHERE contains(query, 'and')
  UNION ALL SELECT query_id, 3, replace(query, 'is', 'was') FROM q WHERE contains(query, 'is') UNION ALL SELECT query_id, 4, replace(query, 'is', 'be') FROM q WHERE contains(query, 'is')),
 u AS (SELECT query_id, query, min(o) o FROM r WHERE query <> '' GROUP BY query_id, query UNION ALL SELECT query_id, query || ' 详细解释', 1 FROM q WHERE query_id NOT IN (SELECT query_id FROM r WHERE query <> ''))
 SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY o) - 1 AS variant, query FROM u"""
