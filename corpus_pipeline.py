"""From raw documents to packed training sequences: five of the llm operators in a row.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns the columns of documents (the
last one: the pieces of the packed sequences). ``run`` writes every stage's rows as Parquet in the shared folder and
reads them again for the next.

Defined cases: every stage takes null, empty and very long texts and repeated rows as its operator does (a null text is an
empty one, which the classifier scores like others; of rows that repeat doc_id and text one stays); extra columns of the
documents, whatever their names, go through to the last stage, which returns pieces only; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontaminate, line_dedup, near_join, packing, quality
from larkspur.llm.common import discard, written
from larkspur.plans.tables import table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines the conditional random field finds good enough; it learns from the labels of those not held out."""
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines that many sites share; n_chars follows the text.

    What is mostly such lines stays whole only as a proven copy of another such document, for the join to take.
    """
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_join.one_of_each(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items don't contaminate."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", without_boilerplate),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", uncontaminated),
    ("packing", packed),
]

#: The first stage's model is learned and can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name.split()[0]}")
        discard(before)
    return docs
