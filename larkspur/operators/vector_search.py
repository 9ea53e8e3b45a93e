"""Exact vector search: every query against every vector, as a join of tiles.

Vectors and queries are packed into tiles: rows of up to ``TILE`` vectors of one length as one matrix, with the range of
their norms. Queries' tiles are a table. Where these are few (at most ``MOST_SENT`` bytes) they are sent to all tasks,
vectors' tiles are packed in the tasks that read them, and nothing of the vectors is shuffled. Beyond that tiles are joined
on a grid: a cell is a strip of the vectors' tiles and one of the queries', so a vector travels once for each strip of
queries, not for each tile of them, and a cell is bounded on both sides. Either way the vectors are read once, however many
queries there are, and the driver sees counts only.

A pair of tiles is one matrix product. A task keeps the best ``k`` of each query of a strip over all its pairs, and what
tasks have kept meets in one more aggregation. By inner products, a tile whose greatest norm can't lead above what a task
already keeps is passed over.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.bm25 import ranked
from larkspur.operators.bounded import sent
from larkspur.sources.shared import written
from larkspur.sources.shipping import mapped

#: Vectors of a tile.
TILE = 4096
#: Bytes of the queries' tiles up to which they are sent to all tasks.
MOST_SENT = 32 << 20
#: Tiles of a strip: of queries, and of vectors.
QUERY_STRIP = 4
VECTOR_STRIP = 32
#: Rows of results that a task holds for queries of other strips than the present one.
MOST_HELD = 1 << 20
TILES = "tile long, size int, n int, high double, ids array<{kind}>, matrix binary"


def tiles(vectors: DataFrame, tile: int = TILE) -> DataFrame:
    """TILES of vectors (id, vector), by the length of the vectors; ids are whole numbers or strings.

    Null and empty vectors are in none. ``high``: the greatest norm of a tile. With a third column ``grp`` a tile is of one
    group, which it says.
    """
    grouped = vectors.columns[2:] == ["grp"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for b in batches:
            lists, ids = b.column(1), b.column(0)
            offsets = lists.offsets.to_numpy()
            sizes, flat = np.diff(offsets), lists.values.to_numpy(zero_copy_only=False)
            for size in np.unique(sizes[sizes > 0]):
                rows = np.flatnonzero(sizes == size)
                for some in (rows[i : i + tile] for rows in (_by_group(b.column(2), rows) if grouped else [rows]) for i in range(0, len(rows), tile)):
                    m = flat[offsets[:-1][some][:, None] + np.arange(size)].astype(np.float64)
                    columns = (number, pa.int64()), (int(size), pa.int32()), (len(some), pa.int32()), (float(np.sqrt((m * m).sum(axis=1).max())), pa.float64()), (m.tobytes(), pa.binary())
                    *others, matrix = [pa.array([x], t) for x, t in columns]
                    of = {"grp": b.column(2).take(pa.array(some[:1]))} if grouped else {}
                    yield pa.RecordBatch.from_arrays([*others, pa.ListArray.from_arrays([0, len(some)], ids.take(pa.array(some))), matrix, *of.values()], names=["tile", "size", "n", "high", "ids", "matrix", *of])
                    number += 1

    types = dict(vectors.dtypes)
    return mapped(vectors.filter(F.size("vector") > 0), run, TILES.format(kind=types["id"]) + (f", grp {types['grp']}" if grouped else ""))


def _by_group(groups: pa.Array, rows: np.ndarray) -> list[np.ndarray]:
    """``rows`` of each group."""
    codes = groups.take(pa.array(rows)).dictionary_encode().indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    return np.split(rows[order], np.flatnonzero(np.diff(codes[order])) + 1)


def _row(ids: np.ndarray) -> np.dtype:
    return np.dtype([("query", np.int64), ("id", ids.dtype), ("score", np.float64)])


def best_of(found: np.ndarray, k: int, digits: int) -> np.ndarray:
    """Of rows (query, id, score) the ``k`` best of each query by rounded score, then id."""
    if not len(found):
        return found
    order = np.lexsort((found["id"], -np.round(found["score"], digits), found["query"]))
    found = found[order]
    first = np.flatnonzero(np.concatenate([[True], found["query"][1:] != found["query"][:-1]]))
    place = np.arange(len(found)) - np.repeat(first, np.diff(np.append(first, len(found))))
    return found[place < k]


def _unit(m: np.ndarray, cosines: bool) -> np.ndarray:
    if not cosines:
        return m
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


class _Best:
    """What a task keeps of one tile of queries: their ``k`` best so far."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int | None, least: float, digits: int, cosines: bool):
        self.ids, self.k, self.digits, self.cosines = ids, k, digits, cosines
        self.matrix = _unit(matrix, cosines)
        self.norms = np.linalg.norm(self.matrix, axis=1)
        #: a query_id may stand more than once, with one bound
        self.each, self.of = np.unique(ids, return_inverse=True)
        self.bound = np.full(len(self.each), least)
        self.least = self.bound[self.of]
        self.held: np.ndarray | None = None

    def meet(self, ids: np.ndarray, matrix: np.ndarray, high: float) -> np.ndarray:
        """Take in a tile of vectors; without ``k`` the pairs found are given back."""
        if self.held is None:
            self.held = np.empty(0, dtype=_row(ids))
        # no product is above the product of the norms
        may = np.arange(len(self.ids)) if self.cosines else np.flatnonzero(self.norms * high * (1 + 1e-12) >= self.least - 1e-9)
        if not len(may):
            return self.held[:0]
        scores = self.matrix[may] @ _unit(matrix, self.cosines).T
        least = self.least[may][:, None]
        if self.k is not None:
            at = max(0, scores.shape[1] - self.k)
            least = np.maximum(least, np.partition(scores, at, axis=1)[:, [at]])
        at_q, at_v = np.nonzero(scores >= least - 1e-9)
        out = np.empty(len(at_q), dtype=self.held.dtype)
        out["query"], out["id"], out["score"] = self.ids[may[at_q]], ids[at_v], scores[at_q, at_v]
        if self.k is None:
            return out
        self.held = best_of(np.concatenate([self.held, out]), self.k, self.digits)
        # queries that have k by now need no less than the last of these
        queries, first, n = np.unique(self.held["query"], return_index=True, return_counts=True)
        full = n >= self.k
        at = np.searchsorted(self.each, queries[full])
        self.bound[at] = np.maximum(self.bound[at], self.held["score"][first[full] + n[full] - 1])
        self.least = self.bound[self.of]
        return out[:0]


def _met(pairs: DataFrame, k: int | None, least: float, cosines: bool, digits: int) -> DataFrame:
    """query_id, id, score of pairs of tiles (strip, q_tile, q_ids, q_matrix, ids, matrix, size, high)."""
    kind = dict(pairs.dtypes)["ids"].removeprefix("array<").removesuffix(">")

    def batch(found: np.ndarray) -> pa.RecordBatch:
        ids = pa.array(found["id"].tolist(), pa.string() if kind == "string" else pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(found["query"].copy()), ids, pa.array(found["score"].copy())], names=["query_id", "id", "score"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Best] = {}
        strip = None
        for b in batches:
            for row in range(b.num_rows):
                of, tile, q_ids, q_matrix, ids, matrix, size, high = (c[row] for c in b.columns)
                if of.as_py() != strip and sum(len(x.held) for x in held.values()) > MOST_HELD:
                    yield from (batch(x.held) for x in held.values())
                    held.clear()
                strip = of.as_py()
                if tile.as_py() not in held:
                    own = q_ids.values.to_numpy(zero_copy_only=False)
                    held[tile.as_py()] = _Best(own, np.frombuffer(q_matrix.as_buffer(), dtype=np.float64).reshape(len(own), -1), k, least, digits, cosines)
                own = ids.values.to_numpy(zero_copy_only=False)
                found = held[tile.as_py()].meet(own, np.frombuffer(matrix.as_buffer(), dtype=np.float64).reshape(len(own), size.as_py()), high.as_py())
                if len(found):
                    yield batch(found)
        yield from (batch(x.held) for x in held.values())

    return mapped(pairs.select("strip", "q_tile", "q_ids", "q_matrix", "ids", "matrix", "size", "high"), run, f"query_id long, id {kind}, score double")


def _scored(chunks: DataFrame, queries: DataFrame, k: int | None, threshold: float | None, cosines: bool, digits: int) -> DataFrame:
    """The ``k`` best of each task for each query, or all pairs from the threshold on."""
    named = lambda t: t.select(*[F.col(c).alias(f"q_{c}") for c in ("tile", "ids", "matrix")], F.col("size").alias("q_size"))
    asked = written(tiles(queries.select(F.col("query_id").cast("long").alias("id"), F.col("query_vec").cast("array<double>").alias("vector"))), "queries")
    many = asked.agg(F.count("*"), F.sum(F.col("n") * F.col("size").cast("long") * 8)).first()
    kind = "string" if dict(chunks.dtypes)["id"] == "string" else "long"
    own = tiles(chunks.select(F.col("id").cast(kind).alias("id"), F.col("embedding").cast("array<double>").alias("vector")))
    least = -np.inf if threshold is None else threshold
    if (many[1] or 0) <= MOST_SENT:
        pairs = own.join(F.broadcast(named(asked)), F.col("size") == F.col("q_size")).withColumn("strip", F.lit(0))
        return _met(pairs, k, least, cosines, digits)
    strips = -(-many[0] // QUERY_STRIP)
    # a table, since its tiles are counted: a copy of the vectors as matrices
    own = written(own, "vectors")
    rows = max(1, -(-own.count() // VECTOR_STRIP))
    across = own.select("*", F.pmod(F.xxhash64("tile"), F.lit(rows)).alias("row"), F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("strip"))
    down = named(asked).select("*", F.pmod(F.xxhash64("q_tile"), F.lit(strips)).cast("int").alias("q_strip"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))).alias("q_row"))
    cell = (F.col("size") == F.col("q_size")) & (F.col("row") == F.col("q_row")) & (F.col("strip") == F.col("q_strip"))
    return _met(across.join(down.hint("merge"), cell), k, least, cosines, digits)


def vector_search(chunks: DataFrame, queries: DataFrame, k: int = 5, threshold: float | None = None, cosines: bool = True, digits: int = 9) -> DataFrame:
    """query_id, id, score, rank: the ``k`` vectors (id, embedding) most like each query (query_id, query_vec).

    Vectors that are null, empty or of another length don't answer; scores below ``threshold`` don't count, nor do
    those that aren't above 0. ``cosines``: cosine similarity, else the inner product.
    """
    scores = _scored(chunks, queries, k, threshold, cosines, digits).withColumn("score", F.round("score", digits))
    return ranked(scores if threshold is None else scores.filter(F.col("score") >= threshold), k, digits)


def nearest(chunks: DataFrame, queries: DataFrame, k: int, cosines: bool = True, digits: int = 9) -> DataFrame:
    """vector_search() whatever the scores are, also below 0."""
    return ranked(_scored(chunks, queries, k, None, cosines, digits), k, digits, positive=False)


def nearest_within(chunks: DataFrame, queries: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """nearest() among the vectors (id, grp, embedding) of the groups that a query (query_id, grp, query_vec) has rows of.

    Tiles are of one group each and meet those of its queries. The grid of a group that isn't sent follows from its own
    tiles, so a large group lies over many tasks, and a vector travels to the strips of its group alone.
    """
    chosen = lambda df, n, vector, kind: tiles(df.select(F.col(n).cast(kind).alias("id"), F.col(vector).cast("array<double>").alias("vector"), "grp").filter(F.col("grp").isNotNull()).sortWithinPartitions("grp"))
    asked = written(chosen(queries, "query_id", "query_vec", "long"), "queries")
    own = chosen(chunks, "id", "embedding", "string" if dict(chunks.dtypes)["id"] == "string" else "long")
    named = asked.select(*[F.col(c).alias(f"q_{c}") for c in ("tile", "ids", "matrix", "size", "grp")])
    same = (F.col("size") == F.col("q_size")) & (F.col("grp") == F.col("q_grp"))
    if (asked.agg(F.sum(F.col("n") * F.col("size").cast("long") * 8)).first()[0] or 0) <= MOST_SENT:
        pairs = own.join(F.broadcast(named), same).withColumn("strip", F.lit(0))
    else:
        own = written(own, "vectors")
        some = lambda t, most, n: t.groupBy("grp").agg(F.ceil(F.count("*") / most).cast("int").alias(n))
        grids = written(some(asked, QUERY_STRIP, "strips").join(some(own, VECTOR_STRIP, "rows"), "grp"), "grids")
        across = own.join(sent(grids), "grp").select(*own.columns, F.pmod(F.xxhash64("tile"), F.col("rows")).cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("number"))
        down = named.join(sent(grids.withColumnRenamed("grp", "q_grp")), "q_grp")
        down = down.select(*named.columns, F.pmod(F.xxhash64("q_tile"), F.col("strips")).cast("int").alias("q_number"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("q_row"))
        cell = same & (F.col("row") == F.col("q_row")) & (F.col("number") == F.col("q_number"))
        pairs = across.join(down.hint("merge"), cell).withColumn("strip", F.xxhash64("grp", "number"))
    return ranked(_met(pairs, k, -np.inf, True, digits), k, digits, positive=False)


def similar_pairs(chunks: DataFrame, queries: DataFrame, threshold: float, cosines: bool = True, digits: int = 9) -> DataFrame:
    """query_id, id, score of all pairs of equal length whose rounded score is at least ``threshold``."""
    scores = _scored(chunks, queries, None, threshold - 10.0**-digits, cosines, digits)
    return scores.withColumn("score", F.round("score", digits)).filter(F.col("score") >= threshold)
