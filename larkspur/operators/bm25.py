"""BM25 over a set of chunks, for many queries at once.

The chunks are read and tokenized once: postings meet the queries' terms right after the explode, so only matching ones are
shuffled, and with one more row a chunk, which has its length, they are a table that all statistics come from. What is sent
to all tasks is counted first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import let, term_counts, tokenize
from larkspur.operators.bounded import sent
from larkspur.sources.shared import written

K1 = 1.5
B = 0.75


def term_frequencies(chunks: DataFrame, id_column: str = "id") -> DataFrame:
    """id, term, tf, dl (the chunk's tokens); a chunk's terms are counted within its row, so nothing is shuffled."""
    each = counted_terms(chunks.select(F.col(id_column).alias("id"), "text")).select("id", "dl", F.inline("terms"))
    return each.select("id", "term", F.col("tf").cast("long").alias("tf"), F.col("dl").cast("long").alias("dl"))


def counted_terms(chunks: DataFrame) -> DataFrame:
    """``chunks`` with dl (tokens) and terms (array of term, tf) in place of text."""
    whole = let(term_counts(F.col("text")), lambda t: F.struct(F.aggregate(t, F.lit(0), lambda s, x: s + x["tf"]).alias("dl"), t.alias("terms")))
    # a row that makes one row, so that what follows doesn't count again for each term
    return chunks.select(*[c for c in chunks.columns if c != "text"], F.inline(F.array(whole)))


def document_frequencies(frequencies: DataFrame) -> DataFrame:
    """term, df: chunks that have the term."""
    return frequencies.groupBy("term").agg(F.count("*").alias("df"))


def corpus_statistics(chunks: DataFrame) -> DataFrame:
    """One row: n (chunks) and avgdl (tokens a chunk)."""
    return chunks.select(F.size(tokenize(F.col("text"))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, qtf: how often a query (query_id, query) says each term."""
    return queries.select("query_id", F.explode(tokenize(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def matching_postings(chunks: DataFrame, terms: DataFrame, id_column: str = "id") -> DataFrame:
    """id, term, tf, dl of the terms (term) that are looked for, and of each chunk a row of the term "", which no text has."""
    wanted = terms.select("term").distinct().unionByName(terms.sparkSession.range(1).select(F.lit("").alias("term")))
    led = chunks.select(F.col(id_column).alias("id"), tokenize(F.col("text")).alias("__ts")).select("id", F.size("__ts").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "__ts")).alias("term"))
    return led.join(sent(wanted), "term", "left_semi").groupBy("id", "term").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))


def bm25_scores(chunks: DataFrame, queries: DataFrame, id_column: str = "id") -> DataFrame:
    """query_id, id, score of every chunk that has a term of the query."""
    terms = written(query_terms(queries), "terms")
    postings = written(matching_postings(chunks, terms, id_column), "postings")
    tf = postings.filter(F.col("term") != "")
    # one row of statistics
    statistics = postings.filter(F.col("term") == "").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weighed = document_frequencies(tf).crossJoin(F.broadcast(statistics)).select("term", "avgdl", idf.alias("idf"))
    of_query = terms.join(weighed, "term")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return tf.join(sent(of_query), "term").groupBy("query_id", "id").agg(F.sum(part).alias("score"))


def ranked(scores: DataFrame, k: int, digits: int = 9, positive: bool = True) -> DataFrame:
    """The ``k`` best of each query by score (above 0 if ``positive``) rounded to ``digits``, then id: query_id, id, score, rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    rounded = (scores.filter(F.col("score") > 0) if positive else scores).withColumn("score", F.round("score", digits))
    return rounded.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def bm25_search(chunks: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "id") -> DataFrame:
    return ranked(bm25_scores(chunks, queries, id_column), k)
