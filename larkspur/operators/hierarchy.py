"""A three-layer index (summary, paragraphs, sentences) and search from the top layer down.

Nodes are one table: id, document_id, layer (0 to 2), text, embedding, parent. Children are found by joining on parent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import index_paragraphs, index_sentences
from larkspur.operators.bm25 import ranked
from larkspur.operators.bounded import sent
from larkspur.operators.fusion import first_of_text
from larkspur.operators.vector_search import nearest, nearest_within
from larkspur.sources.shared import written

SUMMARY, PARAGRAPH, SENTENCE = 0, 1, 2
MAX_SUMMARY = 500
MAX_PARAGRAPH = 2000
#: What a paragraph's score is worth where sentences don't fill the result.
FILL = 0.95


def joined_chunks(chunks: DataFrame) -> DataFrame:
    """document_id, text: a document's chunks in order, each followed by a line feed.

    A document's text is one value, so a task holds the largest document; documents are dealt out by their id.
    """
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: F.concat(x["text"], F.lit("\n")))
    return chunks.groupBy("document_id").agg(F.array_join(parts, "").alias("text"))


def summary_of(text: Column, most: int = MAX_SUMMARY) -> Column:
    """The stand-in for a model's summary: the first characters."""
    return F.substr(text, F.lit(1), F.lit(most))


def build_nodes(texts: DataFrame, embed: Callable[[Column], Column], summarize: Callable[[Column], Column] = summary_of, longest: int = MAX_PARAGRAPH) -> DataFrame:
    """Nodes of documents (document_id, text). ``embed``: a column of texts to a column of vectors.

    Ids are the document's and the ordinals of paragraph and sentence. A summary that has no vector is an error; other
    nodes without one are left out.
    """
    key = F.col("document_id").cast("string")
    top = texts.select(F.concat(key, F.lit("-summary")).alias("id"), "document_id", F.lit(SUMMARY).alias("layer"), summarize(F.col("text")).alias("text"), F.lit(None).cast("string").alias("parent"))
    paragraphs = texts.select("document_id", F.posexplode(index_paragraphs(F.col("text"), longest)).alias("n", "text")).select(
        F.concat(key, F.lit("-p"), F.col("n")).alias("id"), "document_id", F.lit(PARAGRAPH).alias("layer"), "text", F.concat(key, F.lit("-summary")).alias("parent")
    )
    sentences = paragraphs.select("document_id", F.col("id").alias("parent"), F.posexplode(index_sentences(F.col("text"))).alias("n", "text")).select(
        F.concat("parent", F.lit("-s"), F.col("n")).alias("id"), "document_id", F.lit(SENTENCE).alias("layer"), "text", "parent"
    )
    nodes = top.unionByName(paragraphs).unionByName(sentences).withColumn("embedding", embed(F.col("text")))
    checked = F.when((F.col("layer") == SUMMARY) & F.col("embedding").isNull(), F.raise_error(F.lit("a summary has no vector"))).otherwise(F.col("embedding"))
    return nodes.withColumn("embedding", checked).filter(F.col("embedding").isNotNull())


def nodes_of(nodes: DataFrame, document_id=None, layer: int | None = None) -> DataFrame:
    """Nodes of a document, of a layer, or of both."""
    if document_id is not None:
        nodes = nodes.filter(F.col("document_id") == F.lit(document_id))
    return nodes if layer is None else nodes.filter(F.col("layer") == layer)


def _best(nodes: DataFrame, queries: DataFrame, k: int, within: DataFrame | None = None) -> DataFrame:
    """The ``k`` nodes most like each query, of the children of ``within`` (query_id, id) where given.

    They are found by tiles, of a layer or of a parent's children, of which a task keeps the best; so no pair becomes a row.
    """
    if within is None:
        found = nearest(nodes, queries, k).drop("rank")
    else:
        asked = written(within.select("query_id", F.col("id").alias("grp")).join(sent(queries), "query_id"), "asked")
        fit = nearest_within(nodes.select("id", F.col("parent").alias("grp"), "embedding"), asked, k)
        found = written(ranked(fit.drop("rank").unionByName(_unlike(nodes, asked, k)), k, positive=False).drop("rank"), "found")
    return nodes.select("id", "document_id", "layer", "text").join(sent(found), "id").select("query_id", "id", "document_id", "layer", "text", "score")


def _unlike(nodes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, id, score of children whose vector is null, empty or of another length than the query's: 0, so the first ``k`` by id
    of a parent and length are enough."""
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    order = Window.partitionBy("parent", "size").orderBy("id")
    first = nodes.select("id", "parent", size("embedding").alias("size")).withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= k)
    other = (F.col("parent") == F.col("grp")) & ((F.col("size") != F.col("q_size")) | (F.col("size") == 0))
    return asked.select("query_id", "grp", size("query_vec").alias("q_size")).join(first, other).select(F.col("query_id").cast("long").alias("query_id"), "id", F.lit(0.0).alias("score"))


def hierarchical_search(nodes: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, id, document_id, layer, text, score, rank: the best sentences below the best paragraphs below the best
    summaries, filled up with paragraphs at a discount; one row for each document and text.
    """
    # a few rows a query: tables, since they are counted and read more than once
    tops = written(_best(nodes_of(nodes, layer=SUMMARY), queries, k), "tops")
    middles = written(_best(nodes_of(nodes, layer=PARAGRAPH), queries, 2 * k, tops), "middles")
    lows = _best(nodes_of(nodes, layer=SENTENCE), queries, k, middles)
    short = queries.select("query_id").join(lows.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").filter(F.coalesce("n", F.lit(0)) < k).select("query_id")
    fill = middles.join(short, "query_id", "left_semi").withColumn("score", F.round(F.col("score") * FILL, 9))
    both = lows.unionByName(fill)
    once = first_of_text(both.withColumn("__doc", F.col("document_id")).withColumn("document_id", F.struct("query_id", "document_id"))).withColumn("document_id", F.col("__doc")).drop("__doc")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return once.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)
