"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], warm, median of three: one JSON line."""

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))
os.environ.setdefault("OMP_NUM_THREADS", "1")

HEADLINE = ("bm25_search", "vector_search", "hybrid_search", "keyword_search", "chunk_documents", "html_strip", "tokenize", "term_freq", "sentences", "list_page", "orphan_chunks", "hier_search", "kg_subgraph")


def main() -> None:
    from pyspark.sql import SparkSession

    from larkspur.plans import catalogue

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.openCostInBytes", str(1 << 20)).config("spark.sql.files.maxPartitionBytes", str(4 << 20)).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = catalogue.queries(), {}
    for name in HEADLINE:
        took = []
        for _ in range(4):
            began = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        seconds[name] = round(median(took[1:]), 3)
    print(json.dumps({"metric": "headline queries, warm, median of 3", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
