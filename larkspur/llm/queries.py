"""The operators' registered queries and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import collocations, decontaminate, fill_middle, fingerprint, licenses, line_dedup, near_join, packing, pii, quality, repeats, token_counts, toxicity
from larkspur.plans.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.dedup_lines(table(spark, sf_dir, "documents")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.digest(quality.score_documents(docs, quality.learn(docs, table(spark, sf_dir, "labels"))))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.edited_counts(table(spark, sf_dir, "documents"))


def op4_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_classes(table(spark, sf_dir, "documents")).drop("text_key")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan_licenses(table(spark, sf_dir, "documents")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.digest(toxicity.score_documents(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"))))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_pairs(table(spark, sf_dir, "documents"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def queries() -> dict[str, Query]:
    found = [f for name, f in globals().items() if name.startswith("op")]
    return {f.__name__: f for f in sorted(found, key=lambda f: int(f.__name__[2:].split("_")[0]))}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.SQL, "op4_near_join": near_join.SQL, "op7_license_scan": licenses.SQL, "op9_decontaminate": decontaminate.SQL, "op11_fill_middle": fill_middle.SQL, "op12_collocations": collocations.sql()}
