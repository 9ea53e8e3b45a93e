"""Judging a result list, and what follows from the judgement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIGH, LOW, UNCERTAIN = "HIGH", "LOW", "UNCERTAIN"
HIGH_TOP, HIGH_MEAN, HIGH_COUNT = 0.6, 0.6, 2
LOW_TOP, LOW_MEAN = 0.1, 0.15
FIRST = 3


def quality_label(top: float, mean: float, count: int) -> str:
    """The label of a list by its best score, the mean of its first three, and its length."""
    if not count:
        return LOW
    if top >= HIGH_TOP and mean >= HIGH_MEAN and count >= HIGH_COUNT:
        return HIGH
    return LOW if top <= LOW_TOP and mean <= LOW_MEAN else UNCERTAIN


def judged(hits: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """query_id, top_score, mean_score, n_hits, quality of each list (query_id, score, rank); queries without hits are LOW."""
    of = hits.groupBy("query_id").agg(F.max("score").alias("top_score"), F.avg(F.when(F.col("rank") <= FIRST, F.col("score"))).alias("mean_score"), F.count("*").alias("n_hits"))
    if queries is not None:
        of = queries.select("query_id").distinct().join(of, "query_id", "left").na.fill({"top_score": 0.0, "mean_score": 0.0, "n_hits": 0})
    top, mean, n = F.col("top_score"), F.col("mean_score"), F.col("n_hits")
    label = F.when(n == 0, LOW).when((top >= HIGH_TOP) & (mean >= HIGH_MEAN) & (n >= HIGH_COUNT), HIGH).when((top <= LOW_TOP) & (mean <= LOW_MEAN), LOW).otherwise(UNCERTAIN)
    return of.withColumn("quality", label)
