"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the sorted array of the ``k`` smallest distinct 48-bit hashes of a text's five-word shingles. Sketches of
parts merge to the sketch of the whole, and two of them estimate resemblance and containment; one of them estimates how
many distinct shingles there are. All of it is column expressions.

Defined cases: a null text is an empty one; a text without words has the empty sketch; two empty sketches have
resemblance 1, an empty and another one 0; a text of one to four words is a single shingle. With at most ``k`` distinct
shingles a sketch holds them all and every estimate is exact. Texts of any length are read whole; a doc_id is a whole number
or a string of one; ties in order of doc_id can't be, since rows that repeat one are one place; other columns are dropped,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import let, shingle_hashes, words, written

K = 128
BITS = 48
HEX = BITS // 4


def sketch(text: Column, k: int = K) -> Column:
    """The bottom-``k`` sketch of a text's shingles: array<bigint>, ascending."""
    hashes = F.transform(shingle_hashes(words(text)), lambda h: F.shiftrightunsigned(h, 64 - BITS))
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what two sketches were made of."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(parts: DataFrame, by: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """``by`` and ``column``: the sketch of the union of each group's parts, however many there are.

    Hashes are dealt out one by one and made distinct; of each group a task passes on its ``k`` smallest at most.
    """
    each = parts.select(*by, F.explode(column).alias("__h")).distinct()
    smallest = each.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy("__h"))).filter(F.col("__n") <= k)
    merged = smallest.groupBy(*by).agg(F.sort_array(F.collect_list("__h")).alias(column))
    groups = parts.select(*by).distinct()
    same = [groups[c].eqNullSafe(merged[c]) for c in by]
    return groups.join(merged, same, "left").select(*[groups[c] for c in by], F.coalesce(merged[column], F.array().cast("array<bigint>")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, 0 to 1."""

    def share(union: Column) -> Column:
        both = F.size(F.array_intersect(F.array_intersect(union, a), b))
        return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.greatest(F.size(union), F.lit(1)))

    return let(merge(a, b, k), share)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, then (k - 1) over the k-th smallest hash as a fraction."""
    top = F.greatest(F.element_at(F.when(F.size(a) >= k, a), -1), F.lit(1))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * float(1 << BITS) / top)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: resemblance times the union's size over a's."""
    size_a, union = distinct_shingles(a, k), distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / F.greatest(size_a, F.lit(1.0))))


def to_text(a: Column) -> Column:
    """A sketch as a string: 12 hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), HEX, "0")), "")


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, sketch, fingerprint, n_shingles (estimated) of each document."""
    return docs.select("doc_id", sketch(F.col("text"), k).alias("sketch")).select("doc_id", "sketch", to_text(F.col("sketch")).alias("fingerprint"), distinct_shingles(F.col("sketch"), k).alias("n_shingles"))


def successors(ids: DataFrame, column: str) -> DataFrame:
    """(column, next): every distinct value and the one that follows in ascending order, the first after the last; null comes first.

    Values are dealt by range, so no task sees them all; each range's first value is what its predecessor's last needs.
    """
    # written, since the bounds of ranges are sampled: read twice, the plan must see the same ones
    ranged = written(ids.select(column).distinct().repartitionByRange(F.col(column).asc_nulls_first()).withColumn("__range", F.spark_partition_id()), "ranges")
    each = Window.partitionBy("__range").orderBy(F.col(column).asc_nulls_first())
    led = ranged.select(column, "__range", F.lead(F.struct(column)).over(each).alias("__next"))
    edges = led.groupBy("__range").agg(F.min_by(F.struct(column), F.struct(F.col(column).isNotNull(), column)).alias("__first"))
    # one row a range: as many as there are partitions, however long the table
    around = edges.select("__range", F.coalesce(F.lead("__first").over(Window.orderBy("__range")), F.first("__first").over(Window.orderBy("__range"))).alias("__after"))
    return led.join(F.broadcast(around), "__range").select(column, F.coalesce("__next", "__after").getField(column).alias("next"))


def edited_pairs(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of each text and of its edited text.

    The edited text's last floor(n_chars / 2) code points are the first as many of the next document's (or all of them).
    Documents follow each other by doc_id, the first after the last, null before all; rows that repeat a doc_id are one
    place in that order, and what follows from it is the smallest of their beginnings. Of one document alone, it is
    itself. Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    n_shingles, edited_containment.
    """
    place = lambda c: [F.coalesce(c.cast("long"), F.lit(0)).alias("k1"), c.isNull().alias("k2")]
    # both joins read the same columns of it, so Spark deals the texts out once; doc_id is made again from k1 and k2
    own = docs.select(F.coalesce("text", F.lit("")).alias("text"), *place(F.col("doc_id")))
    halves = docs.select("doc_id", F.expr("coalesce(length(text), 0) div 2").alias("half")).groupBy("doc_id").agg(F.max("half").alias("half")).select("half", *place(F.col("doc_id")))
    wanted = successors(docs, "doc_id").select("next", *place(F.col("doc_id"))).join(halves, ["k1", "k2"]).select(F.col("k1").alias("of1"), F.col("k2").alias("of2"), "half", *place(F.col("next")))
    # only texts and beginnings travel; sketches are made where they are needed
    heads = own.join(wanted, ["k1", "k2"]).select(F.col("of1").alias("k1"), F.col("of2").alias("k2"), F.struct(F.expr("substring(text, 1, int(half))").alias("text"), sketch(F.col("text"), k).alias("sk")).alias("head"))
    both = own.join(heads.groupBy("k1", "k2").agg(F.min("head").alias("head")), ["k1", "k2"]).select(
        F.when(~F.col("k2"), F.col("k1")).alias("doc_id"),
        F.length("text").cast("long").alias("n_chars"),
        F.expr("concat(substring(text, 1, int(length(text) - length(text) div 2)), substring(head.text, 1, int(length(text) div 2)))").alias("edited"),
        sketch(F.col("text"), k).alias("sk"),
        F.col("head.sk").alias("next_sk"),
    )
    done = both.withColumn("edited_sk", sketch(F.col("edited"), k))
    a, b = F.col("sk"), F.col("edited_sk")
    return done.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        to_text(a).alias("fingerprint"),
        to_text(b).alias("edited_fingerprint"),
        resemblance(a, b, k).alias("near_edited"),
        resemblance(a, F.col("next_sk"), k).alias("near_next"),
        distinct_shingles(a, k).alias("n_shingles"),
        containment(a, b, k).alias("edited_containment"),
    )


#: What needs no sketch, over small tables in DuckDB.
EDITED_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') t, length(coalesce(text, '')) n, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) f FROM documents)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(substr(t, 1, n - n // 2) || substr(f, 1, n // 2)) AS edited_sha256 FROM d
"""
