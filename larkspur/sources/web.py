"""Web results as a data source, and rewriting as a table function: both for DataFrames and SQL.

    register(spark)
    spark.read.format("web_results").option("url", ...).option("queries", json.dumps(["first", "second"])).load()
    SELECT q.query_id, r.* FROM q, LATERAL rewritten(q.query, 3) r
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf

from larkspur.operators.rewrite import MAX_QUERIES, RewriteRules
from larkspur.sources.models import HttpWebSearch, rule_rewriter
from larkspur.sources.shipping import send_package

RESULTS = "query_id long, query string, id string, document_id string, text string, score double, error string"


class Asked(InputPartition):
    """One query."""

    def __init__(self, number: int, query: str):
        super().__init__(number)
        self.query = query


class WebResults(DataSource):
    """Results of a search service, a partition for each query, asked by the tasks.

    Options: ``url``, ``api_key``, ``top_k`` (5), and ``queries``, a JSON array of strings, whose places are their query_id.
    A query that fails gives one row, which says why; with ``strict`` true it fails the job.
    """

    @classmethod
    def name(cls) -> str:
        return "web_results"

    def schema(self) -> str:
        return RESULTS

    def reader(self, schema) -> WebReader:
        return WebReader(dict(self.options))


class WebReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "url" not in options or "queries" not in options:
            raise ValueError("web_results needs the options url and queries")
        self.queries = json.loads(options["queries"])
        self.k, self.strict = int(options.get("top_k", 5)), str(options.get("strict", "false")).lower() == "true"
        self.search = HttpWebSearch(options["url"], options.get("api_key", ""))

    def partitions(self) -> list[Asked]:
        return [Asked(n, q) for n, q in enumerate(self.queries)]

    def read(self, partition: Asked) -> Iterator[tuple]:
        try:
            found = self.search(partition.query, self.k)
        except Exception as e:
            if self.strict:
                raise
            yield partition.value, partition.query, None, None, None, None, f"{type(e).__name__}: {e}"
            return
        for r in found:
            yield partition.value, partition.query, r["id"], r["document_id"], r["text"], r["score"], None


def rewriting(rules: RewriteRules = RewriteRules()):
    """A table function of (query, most): variant (from 0), rewritten; the query itself comes first, each once."""

    class Rewritten:
        def eval(self, query: str, most: int = MAX_QUERIES):
            if query is None:
                return
            whole = [query.strip(), *rule_rewriter(query, most, rules)]
            for n, q in enumerate(dict.fromkeys(q for q in whole if q)):
                yield n, q

    return udtf(Rewritten, returnType="variant int, rewritten string")


def register(spark: SparkSession, rules: RewriteRules = RewriteRules(), function: str = "rewritten") -> None:
    """``web_results`` and the table function ``rewritten`` for this session."""
    send_package(spark)
    spark.dataSource.register(WebResults)
    spark.udtf.register(function, rewriting(rules))
