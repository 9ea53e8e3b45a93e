"""Listing documents: search, filters, order and pages as one predicate and one plan."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import ascii_lower
from larkspur.operators.ordering import after_first

#: Rows up to which a page is the end of a list that every task sorts for itself.
MOST_SORTED = 10_000
#: Filter keys and the column that each asks for.
FILTERS = {"status": "status", "type": "doc_type", "doc_type": "doc_type", "name": "name", "path": "file_path", "file_path": "file_path"}


@dataclass(frozen=True)
class DocumentQuery:
    """What to list: a text in name or path, exact values by key, and a page of the result. Limit 0 is no limit."""

    search: str = ""
    filters: dict[str, list[str]] = field(default_factory=dict)
    limit: int = 0
    offset: int = 0

    def __post_init__(self) -> None:
        if self.limit < 0 or self.offset < 0:
            raise ValueError("limit and offset can't be negative")
        if unknown := sorted(set(self.filters) - set(FILTERS)):
            raise ValueError(f"unknown filter: {', '.join(unknown)}")

    def predicate(self) -> Column:
        """True for the documents asked for; ASCII case doesn't matter to the search, and its signs stand for themselves."""
        parts = [F.lit(True)]
        if text := self.search.strip():
            wanted = ascii_lower(F.lit(text))
            parts.append(F.contains(ascii_lower(F.col("name")), wanted) | F.contains(ascii_lower(F.col("file_path")), wanted))
        parts += [F.col(FILTERS[k]).isin(*v) for k, v in sorted(self.filters.items()) if v]
        return reduce(lambda a, b: a & b, parts)


def page_offset(limit: int, offset: int = 0, page: int = 0) -> int:
    """Rows before a page (from 1 on), which overrides ``offset``; page 0 is none asked for."""
    if limit < 0 or offset < 0 or page < 0:
        raise ValueError("limit, offset and page can't be negative")
    if page and not limit:
        raise ValueError("a page needs a limit")
    return (page - 1) * limit if page else offset


def parse_filters(flags: list[str]) -> dict[str, list[str]]:
    """``key=value`` flags by key; the first ``=`` parts them, both sides are trimmed and not empty."""
    out: dict[str, list[str]] = {}
    for flag in flags:
        key, sign, value = (x.strip() for x in flag.partition("="))
        if not (key and sign and value):
            raise ValueError(f"not key=value: {flag}")
        out.setdefault(key, []).append(value)
    return out


def select_documents(docs: DataFrame, query: DocumentQuery) -> DataFrame:
    return docs.filter(query.predicate())


def list_documents(docs: DataFrame, query: DocumentQuery = DocumentQuery()) -> DataFrame:
    """The page asked for, newest first, ids descending among equals.

    Near the top of the list the best rows of each task are enough; what lies deep, or has no end, is found by counting
    ranges of the order, so that no task and not the driver goes through all that comes before.
    """
    found, order = select_documents(docs, query), [F.desc("created_at"), F.desc("id")]
    if query.offset and (not query.limit or query.offset + query.limit > MOST_SORTED):
        return after_first(found, order, query.offset, query.limit or None)
    found = found.orderBy(*order)
    found = found.offset(query.offset) if query.offset else found
    return found.limit(query.limit) if query.limit else found


def documents_after(docs: DataFrame, last: tuple | None, limit: int, query: DocumentQuery = DocumentQuery()) -> DataFrame:
    """The next ``limit`` documents after the one of ``last`` (created_at, id), or the first ones: pages that don't count rows."""
    found = select_documents(docs, query)
    if last is not None:
        at, i = (F.lit(x) for x in last)
        found = found.filter((F.col("created_at") < at) | (F.col("created_at") == at) & (F.col("id") < i))
    return found.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def count_documents(docs: DataFrame, query: DocumentQuery = DocumentQuery()) -> DataFrame:
    """One row, ``total``: all documents asked for, whatever the page."""
    return select_documents(docs, query).agg(F.count("*").alias("total"))


def with_document(hits: DataFrame, docs: DataFrame, missing: str = "") -> DataFrame:
    """Hits with document_name and file_path of their document, ``missing`` where it is gone."""
    names = docs.select(F.col("id").alias("document_id"), F.col("name").alias("document_name"), "file_path")
    joined = hits.join(names, "document_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(missing)) for c in ("document_name", "file_path")})


def live_chunks(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks whose document exists."""
    return chunks.join(docs.select(F.col("id").alias("document_id")), "document_id", "left_semi")


def orphan_chunks(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks whose document is gone."""
    return chunks.join(docs.select(F.col("id").alias("document_id")), "document_id", "left_anti")


def chunk_at(chunks: DataFrame, docs: DataFrame, document_id, index: int) -> DataFrame:
    if index < 0:
        raise ValueError("a chunk's index can't be negative")
    return live_chunks(chunks.filter((F.col("document_id") == document_id) & (F.col("chunk_index") == index)), docs)


def chunks_of(chunks: DataFrame, docs: DataFrame, document_id) -> DataFrame:
    return live_chunks(chunks.filter(F.col("document_id") == document_id), docs).orderBy("chunk_index")


def embedded(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.col("embedding").isNotNull())


def keyword_candidates(chunks: DataFrame, query: str, mode: str = "any_term") -> DataFrame:
    """Chunks that may answer a keyword query.

    ``any_term``: they have one of its words; ``phrase``: its text, ASCII case aside; ``raw_like``: they match it as a
    LIKE pattern, whose ``%`` and ``_`` stand for anything.
    """
    from larkspur.functions.text import tokenize

    text = ascii_lower(F.col("text"))
    if mode == "phrase":
        return chunks.filter(F.contains(text, ascii_lower(F.lit(query))))
    if mode == "raw_like":
        return chunks.filter(F.like(text, F.concat(F.lit("%"), ascii_lower(F.lit(query)), F.lit("%"))))
    if mode == "any_term":
        return chunks.filter(F.arrays_overlap(tokenize(F.col("text")), tokenize(F.lit(query))))
    raise ValueError(f"unknown mode: {mode}")
