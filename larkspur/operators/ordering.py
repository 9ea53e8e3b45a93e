"""Places of rows in an order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.sources.shared import written

_LOW = (1 << 33) - 1


def _ranged(df: DataFrame, order: list[Column], parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with __range and __at, their place in the range; __range, n): ranges of the order, sorted, as a table."""
    dealt = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    # the number of a row says which partition it is in and where: once written, both stay as they are
    numbered = written(dealt.sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()), "ranges")
    placed = numbered.select(*df.columns, F.shiftright("__m", 33).alias("__range"), F.col("__m").bitwiseAND(_LOW).alias("__at"))
    return placed, placed.groupBy("__range").agg(F.count("*").alias("n"))


def numbered(df: DataFrame, order: list[Column], within: str | None = None, name: str = "place", parts: int | None = None) -> DataFrame:
    """``df`` with ``name``: each row's place (from 0) in the order, or in the part of it that has its value of ``within``.

    Rows are dealt out by ranges and counted by range; only the counts, a few numbers for each range (and value), are summed
    up in order. A group of any size lies over as many ranges as it needs.
    """
    full = [F.col(within).asc_nulls_first(), *order] if within else order
    placed, counts = _ranged(df, full, parts)
    if within is None:
        # one row a range
        before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
        return placed.join(F.broadcast(starts), "__range").select(*df.columns, (F.col("__start") + F.col("__at")).alias(name))
    each = placed.groupBy("__range", within).agg(F.count("*").alias("n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(within).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = each.select("__range", F.col(within).alias("__key"), "__first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    joined = placed.withColumnRenamed("__range", "__own").join(starts, (F.col("__own") == F.col("__range")) & F.col(within).eqNullSafe(F.col("__key")))
    return joined.select(*df.columns, (F.col("__start") + F.col("__at") - F.col("__first")).alias(name))


def after_first(df: DataFrame, order: list[Column], skip: int, limit: int | None = None) -> DataFrame:
    """Rows of the order but the first ``skip``, at most ``limit``, in order."""
    placed, counts = _ranged(df, order)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # one row a range; ranges that the page doesn't touch aren't read
    starts = counts.select("__range", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start")).filter(F.col("__start") + F.col("n") > skip)
    if limit is not None:
        starts = starts.filter(F.col("__start") < skip + limit)
    found = placed.join(F.broadcast(starts.select("__range", "__start")), "__range").withColumn("__place", F.col("__start") + F.col("__at"))
    found = found.filter(F.col("__place") >= skip) if limit is None else found.filter(F.col("__place").between(skip, skip + limit - 1))
    return found.orderBy("__place").select(*df.columns)
