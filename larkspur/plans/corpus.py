"""The engine's logical tables over the driver's: documents, chunks, queries, wiki and graph."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.inverted import KeywordIndex
from larkspur.operators.skipping import TextFilters, write_filters
from larkspur.plans.tables import spread, state, table
from larkspur.sources.shared import run_dir

#: Queries are the rows whose id is divisible by this.
EVERY = 20


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """id, name, file_path, doc_type, status, created_at of the driver's documents."""
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.lit("indexed").alias("__s")).dropDuplicates(["id"])
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("name"),
        F.concat("source", F.lit("/"), F.col("doc_id"), F.lit(".txt")).alias("file_path"),
        F.col("lang").alias("doc_type"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") % 1000 * 60).alias("created_at"),
    )
    return docs.join(labelled, "id", "left").withColumn("status", F.coalesce("__s", F.lit("indexing"))).drop("__s")


DOCUMENTS = """docs AS (SELECT d.doc_id AS id, 'doc-' || d.doc_id AS name, d.source || '/' || d.doc_id || '.txt' AS file_path, d.lang AS doc_type,
 CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) THEN 'indexed' ELSE 'indexing' END AS status, make_timestamp((1700000000 + d.doc_id % 1000 * 60) * 1000000) AS created_at FROM documents d)"""


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """One chunk for each document: id, document_id, chunk_index, text."""
    return _as_chunks(spread(table(spark, sf, "documents").select("doc_id", "text")))


def undealt_texts(spark: SparkSession, sf: str) -> DataFrame:
    """texts() as they lie, for what deals them out itself."""
    return _as_chunks(table(spark, sf, "documents").select("doc_id", "text"))


def _as_chunks(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"), "text")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as chunks: id, document_id, chunk_index, text."""
    return table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), "text")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as chunks of the document of their number, which may be gone: id, document_id, chunk_index, embedding."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("document_id"), F.lit(0).alias("chunk_index"), "embedding", "label")


def text_queries(spark: SparkSession, sf: str) -> DataFrame:
    """query_id, query: whole benchmark texts."""
    return table(spark, sf, "benchmark").filter(F.col("item_id") % EVERY == 0).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    """query_id, query_vec: vectors of the collection itself."""
    return table(spark, sf, "embeddings").filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def hybrid_queries(spark: SparkSession, sf: str) -> DataFrame:
    """query_id, query, query_vec: a benchmark text and the vector of its number."""
    return text_queries(spark, sf).join(vector_queries(spark, sf), "query_id")


def hybrid_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that have a vector: id, document_id, chunk_index, text, embedding."""
    return texts(spark, sf).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id")


_indexes: dict[tuple, KeywordIndex] = {}


def _indexed(spark: SparkSession, sf: str, chunks: Callable[[SparkSession, str], DataFrame], *tables: str) -> KeywordIndex:
    """The index of some chunks, written when it is first asked for and again when a table that they come from has changed."""
    key = (spark.sparkContext.applicationId, chunks.__name__, *(state(spark, sf, t) for t in tables))
    if key not in _indexes:
        _indexes[key] = KeywordIndex.of(chunks(spark, sf), f"{run_dir(spark)}/index-{uuid.uuid4().hex}")
    return _indexes[key]


def text_index(spark: SparkSession, sf: str) -> KeywordIndex:
    """The index of texts()."""
    return _indexed(spark, sf, undealt_texts, "documents")


def hybrid_index(spark: SparkSession, sf: str) -> KeywordIndex:
    """The index of hybrid_chunks()."""
    return _indexed(spark, sf, hybrid_chunks, "documents", "embeddings")


_filtered: dict[tuple, tuple[str, TextFilters]] = {}


def filtered_texts(spark: SparkSession, sf: str) -> tuple[DataFrame, TextFilters]:
    """texts() in files by ranges of their ids, and the files' filters, written when first asked for."""
    key = (spark.sparkContext.applicationId, state(spark, sf, "documents"))
    if key not in _filtered:
        folder = f"{run_dir(spark)}/filtered-{uuid.uuid4().hex}"
        texts(spark, sf).repartitionByRange(16, "id").write.parquet(f"{folder}/texts")
        write_filters(spark.read.parquet(f"{folder}/texts"), f"{folder}/filters")
        _filtered[key] = f"{folder}/texts", TextFilters(spark, f"{folder}/filters")
    path, filters = _filtered[key]
    return spark.read.parquet(path), filters


def live_documents(spark: SparkSession, sf: str) -> DataFrame:
    """All documents but every seventh, so that chunks without document exist at every size."""
    return documents(spark, sf).filter(F.col("id") % 7 != 0)


def graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(entities, relations): regions, nations, suppliers and customers, and where each lies."""
    region, nation, supplier, customer = (table(spark, sf, t) for t in ("region", "nation", "supplier", "customer"))

    def entity(df: DataFrame, key: str, name: str, kind: str) -> DataFrame:
        return df.select(F.concat(F.lit(f"{kind}-"), F.col(key)).alias("id"), F.col(name).alias("name"), F.lit(kind).alias("type"))

    def relation(df: DataFrame, key: str, kind: str, to: str, to_kind: str) -> DataFrame:
        source, target = F.concat(F.lit(f"{kind}-"), F.col(key)), F.concat(F.lit(f"{to_kind}-"), F.col(to))
        return df.select(F.concat(source, F.lit(">"), target).alias("id"), source.alias("source"), target.alias("target"), F.lit("in").alias("type"))

    entities = entity(region, "r_regionkey", "r_name", "region").unionByName(entity(nation, "n_nationkey", "n_name", "nation")).unionByName(entity(supplier, "s_suppkey", "s_name", "supplier")).unionByName(entity(customer, "c_custkey", "c_name", "customer"))
    relations = relation(nation, "n_nationkey", "nation", "n_regionkey", "region").unionByName(relation(supplier, "s_suppkey", "supplier", "s_nationkey", "nation")).unionByName(relation(customer, "c_custkey", "customer", "c_nationkey", "nation"))
    return entities, relations


GRAPH = """entities AS (SELECT 'region-' || r_regionkey AS id, r_name AS name, 'region' AS type FROM region UNION ALL SELECT 'nation-' || n_nationkey, n_name, 'nation' FROM nation
 UNION ALL SELECT 'supplier-' || s_suppkey, s_name, 'supplier' FROM supplier UNION ALL SELECT 'customer-' || c_custkey, c_name, 'customer' FROM customer),
relations AS (SELECT source || '>' || target AS id, source, target, 'in' AS type FROM (SELECT 'nation-' || n_nationkey AS source, 'region-' || n_regionkey AS target FROM nation
 UNION ALL SELECT 'supplier-' || s_suppkey, 'nation-' || s_nationkey FROM supplier UNION ALL SELECT 'customer-' || c_custkey, 'nation-' || c_nationkey FROM customer))"""
