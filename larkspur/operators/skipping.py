"""Substring and LIKE searches that read only the files which may hold what is looked for.

Beside a table of texts lies a table of filters: for each of its files a Bloom filter of the runs of GRAM bytes in the texts,
A-Z lower-cased. A text holds a string only if its file's filter has all runs of the string, so the others are pruned before
the scan; what is left is compared exactly. Filters have a fixed size, so their table is about a thousandth of a table of
large files, and they are read as a column of bits, in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.shipping import mapped

#: Bytes of a run, bits of a filter, and bits that a run sets.
GRAM = 4
BITS = 1 << 20
HASHES = 2

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MULTIPLY = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def bits_of(data: bytes, bits: int = BITS) -> np.ndarray:
    """The bits that the runs of some lower-cased bytes set, in no order and as often as they are set."""
    a = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    if len(a) < GRAM:
        return np.empty(0, dtype=np.int64)
    runs = (a[:-3] | a[1:-2] << 8 | a[2:-1] << 16 | a[3:] << 24).astype(np.uint64)
    return np.concatenate([(runs * m) >> np.uint64(40) for m in _MULTIPLY[:HASHES]]).astype(np.int64) % bits


def literals(pattern: str) -> list[str]:
    """The strings that every match of a LIKE pattern holds; what an escape stands for is left out."""
    out, now, at = [], "", 0
    while at < len(pattern):
        if pattern[at] in "%_\\":
            out.append(now)
            now = ""
            at += 1 + (pattern[at] == "\\")
        else:
            now += pattern[at]
            at += 1
    return [x for x in [*out, now] if x]


def write_filters(texts: DataFrame, folder: str, column: str | Column = "text", bits: int = BITS) -> None:
    """Filters of the files that ``texts`` is read from: file, words (64 bits each)."""

    def merged(batches: Iterable[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
        """One filter for each file that a task sees, of texts or of filters of its parts."""
        made: dict[str, np.ndarray] = {}
        for b in batches:
            for file, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if file not in made:
                    made[file] = np.zeros(bits if kind == "texts" else bits // 8, dtype=np.uint8)
                if kind == "texts":
                    # a byte for each bit until the file is done: what is set again and again needs no order
                    made[file][bits_of((value.as_py() or "").encode().translate(_LOWER), bits)] = 1
                else:
                    made[file] |= value.values.to_numpy(zero_copy_only=False).view(np.uint8)
            while len(made) > 1 and kind == "texts":
                # files come one after the other: only the last one may go on
                yield one(*next(iter(made.items())), kind)
                made.pop(next(iter(made)))
        for item in made.items():
            yield one(*item, kind)

    def one(file: str, words: np.ndarray, kind: str) -> pa.RecordBatch:
        words = np.packbits(words, bitorder="little") if kind == "texts" else words
        return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([words.view(np.int64)], pa.list_(pa.int64()))], names=["file", "words"])

    schema = "file string, words array<long>"
    parts = mapped(texts.select(F.col("_metadata.file_path").alias("file"), (F.col(column) if isinstance(column, str) else column).alias("text")), partial(merged, kind="texts"), schema)
    mapped(parts.repartition("file"), partial(merged, kind="filters"), schema).write.mode("append").parquet(folder)


class TextFilters:
    """The filters in some folders, of ``bits`` bits each."""

    def __init__(self, spark: SparkSession, *folders: str, bits: int = BITS):
        self.spark, self.folders, self.bits = spark, folders, bits

    def files(self, strings: list[str]) -> DataFrame:
        """file: whose texts may hold all the strings (those shorter than a run say nothing)."""
        filters = self.spark.read.schema("file string, words array<long>").parquet(*self.folders)
        found = F.lit(True)
        for bit in sorted({int(b) for s in strings for b in bits_of(s.encode().translate(_LOWER), self.bits)}):
            found = found & (F.shiftright(F.get("words", F.lit(bit >> 6)), bit & 63).bitwiseAND(F.lit(1)) == 1)
        return filters.filter(found).select("file")

    def pruned(self, texts: DataFrame, strings: list[str]) -> DataFrame:
        """Of a table read from files that have filters the rows of the files that may hold all the strings."""
        # names of files, of which there are far fewer than rows; a search that most files may answer needn't prune
        return texts.filter(F.col("_metadata.file_path").isin([r.file for r in self.files(strings).collect()]))

    def containing(self, texts: DataFrame, string: str, column: str = "text") -> DataFrame:
        """Rows whose text holds the string, ASCII case aside."""
        return self.pruned(texts, [string]).filter(F.contains(_lowered(F.col(column)), _lowered(F.lit(string))))

    def like(self, texts: DataFrame, pattern: str, column: str = "text") -> DataFrame:
        """Rows whose text matches the LIKE pattern somewhere, ASCII case aside."""
        asked = F.concat(F.lit("%"), _lowered(F.lit(pattern)), F.lit("%"))
        return self.pruned(texts, literals(pattern)).filter(F.like(_lowered(F.col(column)), asked))


def _lowered(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
