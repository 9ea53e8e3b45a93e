"""Expressions and helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.sources.shared import discard, written
from larkspur.sources.shipping import mapped

__all__ = ["BETWEEN_WORDS", "NEAR", "SHINGLE", "ascii_lower", "discard", "held_out", "let", "mapped", "shingle_hashes", "words", "written"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Words are runs of ASCII letters and digits and of all that isn't ASCII; this is what lies between them in lower-cased text.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words in a shingle, and the similarity from which two documents are near duplicates.
SHINGLE = 5
NEAR = 0.8


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, in order; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS), "")


def shingle_hashes(word_list: Column, size: int = SHINGLE) -> Column:
    """64-bit hashes of all runs of ``size`` words, with repeats; a shorter text that has words is one shingle."""

    def runs(h: Column) -> Column:
        whole = F.when(F.size(h) > 0, F.array(F.xxhash64(F.concat_ws(",", h.cast("array<string>"))))).otherwise(F.array().cast("array<bigint>"))
        each = F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(size)]))
        return F.when(F.size(h) >= size, each).otherwise(whole)

    return let(F.transform(word_list, lambda w: F.xxhash64(w)), runs)


def held_out(doc_id: Column) -> Column:
    """True for the documents whose labels no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
