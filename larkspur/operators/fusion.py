"""Merging ranked lists: reciprocal rank fusion, keep-best and first-wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.bm25 import ranked

RRF_K = 60


def reciprocal_rank_fusion(*lists: DataFrame, k: int = 5) -> DataFrame:
    """query_id, id, score, rank: the sum of 1 / (60 + rank) over the lists (query_id, id, rank) that have an id."""
    both = reduce(DataFrame.unionByName, [x.select("query_id", "id", "rank") for x in lists])
    return ranked(both.groupBy("query_id", "id").agg(F.sum(1 / (RRF_K + F.col("rank"))).alias("score")), k)


def keep_best(hits: DataFrame) -> DataFrame:
    """Of hits of one chunk that of the highest score; without an id, document and text say which chunk it is."""
    key = F.coalesce(F.when(F.col("id").cast("string") != "", F.col("id").cast("string")), F.concat_ws("|", F.col("document_id").cast("string"), F.sha2("text", 256)))
    return hits.withColumn("__key", key).groupBy("__key").agg(F.max(F.struct("score", F.struct(*hits.columns).alias("hit"))).alias("best")).select("best.hit.*")


def first_of_text(hits: DataFrame) -> DataFrame:
    """Of hits of one document and text that of the highest score, then of the smallest id."""
    order = Window.partitionBy("document_id", "text").orderBy(F.desc("score"), "id")
    return hits.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") == 1).drop("__n")


def merged(*lists: DataFrame) -> DataFrame:
    """The union of hits, each chunk once with its best score."""
    return keep_best(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lists))
