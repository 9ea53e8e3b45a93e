"""Grouping texts into requests: at most so many texts and estimated tokens, and one text at least."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.ordering import numbered
from larkspur.sources.shared import written
from larkspur.sources.shipping import mapped

MAX_TEXTS = 100
MAX_TOKENS = 30_000


def estimate(text: str) -> int:
    return len(text.encode()) // 4


def in_batches(texts: list[str], most: int = MAX_TEXTS, budget: int = MAX_TOKENS) -> Iterator[list[str]]:
    """Consecutive texts in batches."""
    held: list[str] = []
    tokens = 0
    for t in texts:
        n = estimate(t)
        if held and (len(held) >= most or tokens + n > budget):
            yield held
            held, tokens = [], 0
        held.append(t)
        tokens += n
    if held:
        yield held


def _starts(sizes: np.ndarray, length: int, most: int, budget: int) -> np.ndarray:
    """Where the batch after the one that begins at each of ``length`` places begins; at the end of ``sizes`` at most.

    A batch holds its first text, and what follows up to ``most`` texts and ``budget`` tokens.
    """
    sums = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(length)
    full = np.searchsorted(sums, sums[:length] + budget, side="right") - 1
    return np.minimum(np.maximum(at + 1, np.minimum(full, at + most)), len(sizes))


def _slice_map(sizes: np.ndarray, length: int, most: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of a slice's first ``most`` places: where in the next slice the first batch begins, if one begins there, and how many begin before."""
    after = _starts(sizes, length, most, budget)
    leave, count = after - length, np.ones(length, dtype=np.int64)
    for i in np.flatnonzero(after < length)[::-1]:
        leave[i], count[i] = leave[after[i]], 1 + count[after[i]]
    # the last slice of a group may be shorter: nothing begins behind its end
    end = np.zeros(max(0, most - length), dtype=np.int64)
    return np.concatenate([leave[:most], end]), np.concatenate([count[:most], end])


def _numbers(sizes: np.ndarray, length: int, entry: int, batch: int, most: int, budget: int) -> np.ndarray:
    """The batches of a slice's texts, if batch number ``batch`` begins at ``entry``."""
    after, begins, i = _starts(sizes, length, most, budget), np.zeros(length, dtype=np.int64), entry
    while i < length:
        begins[i] = 1
        i = int(after[i])
    return batch - 1 + np.cumsum(begins)


#: Texts of a slice, at least, and slices whose tables are put together at once.
SLICE = 4096
FAN = 64


def batches(rows: DataFrame, group: str, order: str, most: int = MAX_TEXTS, budget: int = MAX_TOKENS, slice_: int | None = None, fan: int | None = None) -> DataFrame:
    """group, order, batch: the batch of each of a group's texts in order; a null text has no tokens.

    Where a batch ends depends on where it begins, and so on all that comes before, but on nothing else of it. So a group is
    cut into slices, and each slice becomes a small table: for each of its first places, at which a batch may begin that
    comes from the slice before, the place in the next slice where the first batch begins, and how many begin before. Such
    tables are put together ``fan`` at a time, level by level, until a group has one; then each level tells the one below
    where its slices are entered. A group of any length lies over many tasks, and none holds more than a slice or ``fan``
    tables.
    """
    size, fan = max(slice_ or SLICE, most), fan or FAN
    tokens = F.floor(F.octet_length("text") / 4).cast("long")
    texts = rows.select(F.col(group).alias("g"), F.col(order).alias("o"), F.coalesce(tokens, F.lit(0)).alias("n"))
    placed = numbered(texts, [F.col("o").asc_nulls_first()], "g").withColumn("slice", F.floor(F.col("place") / size).cast("long"))
    # a slice also sees the texts that its last batch may reach
    also = (F.col("place") % size < most) & (F.col("slice") > 0)
    seen = placed.withColumn("of", F.explode(F.when(also, F.array(F.col("slice") - 1, F.col("slice"))).otherwise(F.array("slice"))))
    slices = seen.groupBy("g", F.col("of").alias("slice")).agg(F.array_sort(F.collect_list(F.struct("place", "n", "o"))).alias("texts"), F.sum((F.col("slice") == F.col("of")).cast("int")).cast("int").alias("length"))
    slices = written(slices, "slices")
    kind = dict(slices.dtypes)["g"]
    table = "leave array<long>, count array<long>"

    def mapped_rows(df: DataFrame, one: Callable[..., tuple], schema: str) -> DataFrame:
        """The first two columns of rows, and what ``one`` makes of the others."""
        names = [f.split()[0] for f in schema.split(", ")]

        def run(batches_: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches_:
                made = [one(*row) for row in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([m[i] for m in made], pa.list_(pa.int64())) for i in range(len(names))]], names=["g", "slice", *names])

        return mapped(df, run, f"g {kind}, slice long, {schema}")

    def table_of(sizes: list[int], length: int) -> tuple:
        return tuple(x.tolist() for x in _slice_map(np.array(sizes, dtype=np.int64), length, most, budget))

    def joined(tables: list[dict]) -> tuple:
        leave, count = np.arange(most), np.zeros(most, dtype=np.int64)
        for t in tables:
            count, leave = count + np.array(t["count"])[leave], np.array(t["leave"])[leave]
        return leave.tolist(), count.tolist()

    def entered(tables: list[dict], entry: int, batch: int) -> tuple:
        entries, numbers = [], []
        for t in tables:
            entries.append(entry)
            numbers.append(batch)
            entry, batch = t["leave"][entry], batch + t["count"][entry]
        return entries, numbers

    def numbers_of(sizes: list[int], length: int, entry: int, batch: int) -> tuple:
        return (_numbers(np.array(sizes, dtype=np.int64), length, entry, batch, most, budget).tolist(),)

    sizes = F.transform("texts", lambda t: t["n"]).alias("sizes")
    longest = slices.agg(F.max("slice")).first()[0] or 0
    levels: list[DataFrame] = []
    if longest:
        tables = written(mapped_rows(slices.select("g", "slice", sizes, "length"), table_of, table), "tables")
    while longest:
        parent = F.floor(F.col("slice") / fan).cast("long")
        levels.append(written(tables.groupBy("g", parent.alias("slice")).agg(F.array_sort(F.collect_list(F.struct("slice", "leave", "count"))).alias("tables")), "level"))
        longest //= fan
        if longest:
            tables = written(mapped_rows(levels[-1].select("g", "slice", "tables"), joined, table), "tables")
    states = slices.select("g").distinct().select("g", F.lit(0).cast("long").alias("slice"), F.lit(0).cast("long").alias("entry"), F.lit(0).cast("long").alias("batch"))

    def beside(df: DataFrame, other: DataFrame) -> DataFrame:
        """Rows of the same slice together."""
        renamed = other.withColumnsRenamed({"g": "__g", "slice": "__slice"})
        return df.join(renamed, F.col("g").eqNullSafe(F.col("__g")) & (F.col("slice") == F.col("__slice"))).drop("__g", "__slice")

    for level in reversed(levels):
        below = mapped_rows(beside(level, states).select("g", "slice", "tables", "entry", "batch"), entered, "entries array<long>, numbers array<long>")
        each = below.select("g", F.posexplode(F.arrays_zip("entries", "numbers")).alias("i", "z"), "slice")
        states = written(each.select("g", (F.col("slice") * fan + F.col("i")).alias("slice"), F.col("z.entries").alias("entry"), F.col("z.numbers").alias("batch")), "states")
    # the texts' order stays in the JVM: Python sees their sizes
    done = mapped_rows(beside(slices, states).select("g", "slice", sizes, "length", "entry", "batch"), numbers_of, "batches array<long>")
    both = beside(slices, done).select("g", F.slice("texts", F.lit(1), F.col("length")).alias("texts"), "batches")
    return both.select(F.col("g").alias(group), F.explode(F.arrays_zip("texts", "batches")).alias("z")).select(group, F.col("z.texts.o").alias(order), F.col("z.batches").alias("batch"))
