"""An inverted index of chunks as tables, and BM25 searches that read the terms' postings only.

An index is a folder of parts, each written once for a set of chunks. A part is a table ``postings``, a row for each term and
class of lengths:

* how many postings there are, their greatest and least tf and dl, which bound what they can add to a score;
* ``ids``, ``tfs``, ``dls``: the postings themselves, which are read only where a search wants them;
* ``documents``: of the term "", which no text has and every chunk has once. Its postings are the chunks' lengths.

Rows lie in buckets by the hash of the term (folders, so that a search reads only its terms' buckets) and are sorted by term,
so that row groups are skipped too. Chunks are dealt into segments, and a task makes a segment's files: texts are shuffled, not
postings. Texts are tokenized by Spark; a task counts and packs their postings as numbers, of bounded many at a time, and Spark
sorts the packed rows. So a term has a row or more in each segment, which a search adds up.

Classes are a quarter of a doubling wide, so a term has few of them, and what a posting of a class can add to a score lies
within narrow bounds. A search reads the bounds first and learns from them the document frequencies, the collection's
statistics, a score that the k-th best chunk reaches at least, and which terms and blocks can't lead to that score: their
postings aren't read for candidates, only summed up for the candidates that the others gave. The result is exact.

An index has any number of parts, so ingestion adds its own; chunks that were deleted meanwhile are hidden, and statistics
are those of the chunks that are left.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.text import tokenize
from larkspur.operators.bm25 import B, K1, counted_terms, query_terms, ranked
from larkspur.operators.bounded import sent
from larkspur.sources.shared import written
from larkspur.sources.shipping import mapped

BUCKETS = 32
#: Bytes of texts in a segment, whose files a task makes; and the least that is dealt to one more core.
SEGMENT = 48 << 20
LEAST_SEGMENT = 2 << 20
#: Postings that a task sorts in memory (about 100 bytes each while it does), and postings that go out at once.
MOST_HELD = 4 << 20
AT_ONCE = 1 << 20
#: More than the greatest class of lengths of 31 bits.
CLASSES = 128
PACKED = "term string, class int, n long, max_tf int, min_tf int, max_dl int, min_dl int, total_dl long, ids array<{id}>, tfs array<int>, dls array<int>, documents array<{document}>, bucket int"
#: How much lower a bound may be taken, so that what is rounded and summed in another order still lies within it.
SLACK = 1e-8


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _class(dl: Column) -> Column:
    return F.floor(4 * F.log2(dl + F.lit(1))).cast("int")


def postings_of(chunks: DataFrame, id_column: str = "id") -> DataFrame:
    """term, id, tf, dl, class, document_id of every chunk's terms, and of the term "" once: what a part packs, as rows of columns alone."""
    document = F.col("document_id") if "document_id" in chunks.columns else F.lit(None).cast("string")
    counted = counted_terms(chunks.select(F.col(id_column).alias("id"), document.alias("document_id"), "text"))
    each = counted.select("id", "document_id", "dl", F.inline(F.concat(F.array(F.struct(F.lit("").alias("term"), F.lit(1).alias("tf"))), "terms")))
    return each.select("term", "id", "tf", "dl", _class(F.col("dl")).alias("class"), F.when(F.col("term") == "", F.col("document_id")).alias("document_id"))


def in_segments(chunks: DataFrame, id_column: str = "id", segment: int | None = None) -> DataFrame:
    """``chunks`` dealt by id into as many tasks as their texts have segments, all cores alike; a little table to all cores."""
    total = chunks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cores = chunks.sparkSession.sparkContext.defaultParallelism
    n = max(-(-total // (segment or SEGMENT)), min(cores, -(-total // LEAST_SEGMENT)), 1)
    # a last round of few tasks would keep the other cores waiting
    n -= n % cores if n > cores else 0
    return chunks.select(*[c for c in (id_column, "document_id", "text") if c in chunks.columns]).repartition(n, id_column)


class _Held:
    """Postings of some batches (id, document_id, tokens): a number for each token's term, and the terms of each batch."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.postings = 0

    def add(self, b: pa.RecordBatch) -> None:
        ids, documents, tokens = b.columns
        dl = tokens.value_lengths().to_numpy().astype(np.int64)
        # terms are compared once, as strings; from there on they are numbers
        coded = pc.ascii_lower(tokens.flatten()).dictionary_encode()
        n, row = max(len(coded.dictionary), 1), np.repeat(np.arange(len(dl)), dl)
        key, tf = np.unique(row * n + coded.indices.to_numpy(), return_counts=True)
        self.parts.append((ids, documents, dl, coded.dictionary, key // n, key % n, tf))
        self.postings += len(key) + len(dl)

    def packed(self) -> Iterator[pa.RecordBatch]:
        """A row for each term and class; the term "" is number 0."""
        ids, documents, dls, words, rows, codes, tfs = zip(*self.parts, strict=True)
        # the batches' own numbers of terms become common ones
        known = pa.chunked_array([pa.array([""]), *words]).combine_chunks().dictionary_encode()
        common, begin = known.indices.to_numpy(), 1 + np.cumsum([0, *map(len, words)])
        first, dl = np.cumsum([0, *map(len, dls)]), np.concatenate(dls)
        term = np.concatenate([np.zeros(len(dl), np.int64), *[common[c + at] for c, at in zip(codes, begin, strict=False)]])
        row = np.concatenate([np.arange(len(dl)), *[r + at for r, at in zip(rows, first, strict=False)]])
        tf = np.concatenate([np.ones(len(dl), np.int64), *tfs]).astype(np.int32)
        kinds = np.floor(4 * np.log2(dl + 1)).astype(np.int64)
        group = term * CLASSES + kinds[row]
        order = np.argsort(group, kind="stable")
        group, row, tf = group[order], row[order], tf[order]
        at = np.flatnonzero(np.diff(group, prepend=-1))
        id_of, document_of = (pa.chunked_array(c).combine_chunks() for c in (ids, documents))
        dl = dl[row].astype(np.int32)
        ends = np.append(at, len(group))
        # some rows at a time, so that what goes out at once is small; a row isn't cut
        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, len(group), AT_ONCE)), len(at)))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            x, y = ends[i], ends[j]
            some, r, t, d = at[i:j] - x, row[x:y], tf[x:y], dl[x:y]
            empty = group[at[i:j]] < CLASSES
            offsets = pa.array((ends[i : j + 1] - x).astype(np.int32))
            bounds = [f.reduceat(v, some) for v in (t, d) for f in (np.maximum, np.minimum)]
            total = np.where(empty, np.add.reduceat(d.astype(np.int64), some), 0)
            lists = [pa.ListArray.from_arrays(offsets, v) for v in (id_of.take(pa.array(r)), pa.array(t), pa.array(d))]
            # of the lengths only: other terms' rows have no list
            own = int(ends[i + empty.sum()] - x)
            of_documents = pa.ListArray.from_arrays(pa.array(np.minimum(ends[i : j + 1] - x, own).astype(np.int32)), document_of.take(pa.array(r[:own])), mask=pa.array(~empty))
            names = known.dictionary.take(pa.array(group[at[i:j]] // CLASSES))
            columns = [names, pa.array((group[at[i:j]] % CLASSES).astype(np.int32)), pa.array(np.diff(ends[i : j + 1])), *map(pa.array, bounds), pa.array(total), *lists, of_documents]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PACKED.split(", ")[:-1]])


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches (id, document_id, tokens) a row for each term and class; one more where a task has more than MOST_HELD postings."""
    held = _Held()
    for b in batches:
        if b.num_rows:
            held.add(b)
        if held.postings > MOST_HELD:
            yield from held.packed()
            held = _Held()
    if held.parts:
        yield from held.packed()


def write_part(chunks: DataFrame, folder: str, id_column: str = "id", buckets: int = BUCKETS, segment: int | None = None) -> str:
    """One more part of the index in ``folder``; its name. The chunks are tokenized once; their size is looked at before."""
    name = uuid.uuid4().hex
    document = F.col("document_id") if "document_id" in chunks.columns else F.lit(None).cast("string")
    rows = in_segments(chunks, id_column, segment).select(F.col(id_column).alias("id"), document.alias("document_id"), tokenize(F.col("text"), lower=False).alias("tokens"))
    types, order = dict(rows.dtypes), ("bucket", "term", "class")
    packed = mapped(rows, _packed, PACKED.format(id=types["id"], document=types["document_id"]).removesuffix(", bucket int"))
    packed.withColumn("bucket", bucket_of(F.col("term"), buckets)).sortWithinPartitions(*order).write.partitionBy("bucket").parquet(f"{folder}/postings/part={name}")
    return name


def _each(rows: DataFrame, documents: bool = False) -> DataFrame:
    """The postings of packed ``rows``, each with the row's other columns: id, tf, dl, and the document_id if asked for."""
    lists = {"ids": "id", "tfs": "tf", "dls": "dl"} | ({"documents": "document_id"} if documents else {})
    # arrays that are null or shorter: their elements are null
    zipped = F.arrays_zip(*[F.coalesce(F.col(c), F.array().cast(dict(rows.dtypes)[c])).alias(c) for c in lists])
    others = [c for c in rows.columns if c not in ("ids", "tfs", "dls", "documents")]
    return rows.select(*others, F.inline(zipped)).withColumnsRenamed(lists)


class KeywordIndex:
    """Parts of the index in ``folder``, read as one.

    ``generations``: names of parts by generation, later ones last. ``hidden``: (generation, id) of chunks that are gone.
    ``types``: of id and document_id.
    """

    def __init__(self, spark: SparkSession, folder: str, generations: list[list[str]], hidden: DataFrame | None = None, types: tuple[str, str] = ("string", "string"), buckets: int = BUCKETS):
        self.spark, self.folder, self.hidden, self.types, self.buckets = spark, folder, hidden, types, buckets
        self.generations = [(g, parts) for g, parts in enumerate(generations) if parts]

    @classmethod
    def of(cls, chunks: DataFrame, folder: str, id_column: str = "id", buckets: int = BUCKETS) -> KeywordIndex:
        """An index of one part, written now."""
        types = dict(chunks.dtypes)
        return cls(chunks.sparkSession, folder, [[write_part(chunks, folder, id_column, buckets)]], None, (types[id_column], types.get("document_id", "string")), buckets)

    def _read(self) -> DataFrame:
        """Packed rows of all parts, with their generation."""
        schema = PACKED.format(id=self.types[0], document=self.types[1]) + ", part string"
        root = f"{self.folder}/postings"
        read = self.spark.read.schema(schema).option("basePath", root)
        parts = [read.parquet(*[f"{root}/part={p}" for p in some]).withColumn("generation", F.lit(g)) for g, some in self.generations]
        if not parts:
            return self.spark.createDataFrame([], schema).withColumn("generation", F.lit(0))
        return reduce(DataFrame.unionByName, parts)

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """term, class, generation, id, tf, dl, document_id: postings of all terms or of these; chunks that are gone have none."""
        rows = self._read().select("term", "class", "generation", "bucket", "ids", "tfs", "dls", "documents")
        if terms is not None:
            buckets = sorted({r.b for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(bucket_of(F.col("t"), self.buckets).alias("b")).collect()})
            rows = rows.filter(F.col("term").isin(*terms) & F.col("bucket").isin(*buckets))
        return self._left(_each(rows, documents=True)).drop("bucket")

    def _left(self, postings: DataFrame) -> DataFrame:
        return postings if self.hidden is None else postings.join(sent(self.hidden), ["generation", "id"], "left_anti")

    def lengths(self, generation: bool = False) -> DataFrame:
        """id, document_id, dl of every chunk, and its ``generation`` if asked for."""
        return self.postings([""]).select("id", "document_id", "dl", *["generation"] * generation)

    def _blocks(self, wanted: DataFrame, buckets: list[int]) -> DataFrame:
        """term, class, n and bounds of the terms ``wanted`` (term) over all parts; of chunks that are gone only the bounds remain."""
        rows = self._read().filter(F.col("bucket").isin(*buckets)).join(sent(wanted), "term", "left_semi")
        bounds = [F.max("max_tf").alias("max_tf"), F.min("min_tf").alias("min_tf"), F.max("max_dl").alias("max_dl"), F.min("min_dl").alias("min_dl")]
        if self.hidden is None:
            return rows.groupBy("term", "class").agg(F.sum("n").alias("n"), F.sum("total_dl").alias("total_dl"), *bounds)
        gone = _each(rows.select("term", "class", "generation", "ids", "tfs", "dls")).join(sent(self.hidden), ["generation", "id"], "left_semi")
        less = gone.groupBy("term", "class").agg((-F.count("*")).alias("n"), (-F.sum(F.when(F.col("term") == "", F.col("dl")).otherwise(0))).alias("total_dl"))
        both = rows.select("term", "class", "n", "total_dl", "max_tf", "min_tf", "max_dl", "min_dl").unionByName(less, allowMissingColumns=True)
        return both.groupBy("term", "class").agg(F.sum("n").alias("n"), F.sum("total_dl").alias("total_dl"), *bounds).filter("n > 0")

    def document_frequencies(self) -> DataFrame:
        """term, df of every term, by the rows' counts alone where no chunk is gone."""
        if self.hidden is None:
            return self._read().filter("term <> ''").groupBy("term").agg(F.sum("n").alias("df"))
        return self.postings().filter("term <> ''").groupBy("term").agg(F.count("*").alias("df"))

    def statistics(self) -> DataFrame:
        """One row: n (chunks) and avgdl (tokens a chunk)."""
        return self.lengths().agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))

    def candidates(self, terms: list[str]) -> DataFrame:
        """id of the chunks that have one of these terms."""
        return self.postings(terms).select("id").distinct()

    def plan(self, terms: DataFrame, k: int) -> tuple[DataFrame, DataFrame, list[int]]:
        """What a search of terms (query_id, term, qtf) has to read, and in which buckets.

        (query_id, term, class, weight, avgdl: blocks that may lead to one of the ``k`` best, as ``lead``, or only add to
        what the others found; query_id, least, rest: the score that the k-th best reaches at least, and what the terms
        that don't lead can add.)
        """
        wanted = terms.select("term").distinct().unionByName(self.spark.range(1).select(F.lit("").alias("term")))
        # as many as there are buckets at most
        buckets = sorted(r.b for r in wanted.select(bucket_of(F.col("term"), self.buckets).alias("b")).distinct().collect())
        blocks = written(self._blocks(wanted, buckets), "blocks")
        statistics = blocks.filter("term = ''").agg(F.sum("n").alias("__n"), (F.sum("total_dl") / F.sum("n")).alias("avgdl"))
        frequencies = blocks.filter("term <> ''").groupBy("term").agg(F.sum("n").alias("df"))
        idf = F.ln((F.col("__n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        weighed = frequencies.crossJoin(F.broadcast(statistics)).select("term", "avgdl", idf.alias("idf"))
        each = terms.join(weighed, "term").withColumn("weight", F.col("qtf") * F.col("idf")).join(blocks.filter("term <> ''"), "term")
        each = each.withColumns({"high": F.col("weight") * part(F.col("max_tf"), F.col("min_dl")), "low": F.col("weight") * part(F.col("min_tf"), F.col("max_dl"))})
        # of the classes of one term the best ones, until they have k chunks: so many chunks reach the last one's low bound
        down = Window.partitionBy("query_id", "term").orderBy(F.desc("low"), "class").rowsBetween(Window.unboundedPreceding, 0)
        each = each.withColumn("__so_far", F.sum("n").over(down))
        by_term = each.groupBy("query_id", "term").agg(
            F.when(F.max("__so_far") >= k, F.min(F.when(F.col("__so_far") - F.col("n") < k, F.col("low")))).otherwise(F.lit(0.0)).alias("reached"), F.max("high").alias("most"), F.first("weight").alias("weight"), F.first("avgdl").alias("avgdl")
        )
        # terms that even together don't reach it can't lead to a chunk that does
        query, upward = Window.partitionBy("query_id"), Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
        by_term = by_term.withColumns({"least": F.max("reached").over(query) - SLACK, "total": F.sum("most").over(query), "__below": F.sum("most").over(upward)})
        by_term = written(by_term.withColumn("leads", F.col("__below") >= F.col("least")).drop("__below", "reached"), "terms")
        bounds = by_term.groupBy("query_id").agg(F.max("least").alias("least"), F.sum(F.when(F.col("leads"), 0.0).otherwise(F.col("most"))).alias("rest"))
        chosen = each.select("query_id", "term", "class", "high").join(by_term, ["query_id", "term"])
        may = F.col("leads") & (F.col("high") + F.col("total") - F.col("most") >= F.col("least"))
        return chosen.filter(may | ~F.col("leads")).select("query_id", "term", "class", "weight", "avgdl", F.col("leads").alias("lead")), bounds, buckets

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """query_id, id, score, rank: the ``k`` best chunks of each query (query_id, query) by BM25."""
        # tables of a few rows for each query: Spark knows their size and sends them to the postings if it is small
        terms = written(query_terms(queries), "terms")
        asked, bounds, buckets = self.plan(terms, k)
        asked = written(asked, "asked")
        packed = self._read().filter(F.col("bucket").isin(*buckets)).select("term", "class", "generation", "ids", "tfs", "dls")

        def scored(some: DataFrame) -> DataFrame:
            # packed rows meet the queries before their postings are rows
            found = self._left(_each(packed.join(sent(some.drop("lead")), ["term", "class"])))
            return found.select("query_id", "id", (F.col("weight") * part(F.col("tf"), F.col("dl"))).alias("score"))

        first = scored(asked.filter("lead")).groupBy("query_id", "id").agg(F.sum("score").alias("score"))
        more = asked.filter("not lead")
        if more.isEmpty():
            return ranked(first, k)
        pool = written(first.join(bounds, "query_id").filter(F.col("score") + F.col("rest") >= F.col("least")).select("query_id", "id", "score"), "pool")
        rest = scored(more).join(pool.select("query_id", "id"), ["query_id", "id"], "left_semi")
        return ranked(pool.unionByName(rest).groupBy("query_id", "id").agg(F.sum("score").alias("score")), k)

    def keyword_search(self, terms: list[str], k: int = 5) -> DataFrame:
        """query_id (0), id, score, rank by the statistics of the chunks that have one of the terms (repeats count)."""
        found = written(self.postings(sorted(set(terms))).select("term", "id", "tf", "dl"), "found")
        statistics = found.groupBy("id").agg(F.max("dl").alias("dl")).agg(F.count("*").alias("__n"), F.avg("dl").alias("avgdl"))
        said = self.spark.createDataFrame([(t, terms.count(t)) for t in sorted(set(terms))], "term string, qtf long")
        idf = F.ln((F.col("__n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        weighed = found.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(said), "term").crossJoin(F.broadcast(statistics))
        scores = found.join(F.broadcast(weighed.select("term", "avgdl", (F.col("qtf") * idf).alias("weight"))), "term")
        return ranked(scores.groupBy("id").agg(F.sum(F.col("weight") * part(F.col("tf"), F.col("dl"))).alias("score")).select(F.lit(0).cast("long").alias("query_id"), "id", "score"), k)


def part(tf: Column, dl: Column) -> Column:
    """What a posting adds to a score, for each unit of its term's weight; it grows with tf and falls with dl."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))

