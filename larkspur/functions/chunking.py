"""Splitting texts into overlapping chunks by a fold over paragraphs, all of it column expressions.

Paragraphs are packed while the buffer's estimated tokens stay within ``max_tokens``. When one doesn't fit, the buffer
is emitted and the next begins with its last ``overlap`` words (the whole buffer where it has no more). A buffer above
``hard_tokens`` is cut at sentences, and a sentence above it at words, in order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import clean_edges, folded, let, sentences

_WORD_GAP = r"[\s\x{85}\p{Z}]+"


@dataclass(frozen=True)
class ChunkOptions:
    max_tokens: int = 512
    overlap: int = 100
    hard_tokens: int = 8192
    separator: str = "\n\n"

    @classmethod
    def sized(cls, max_tokens: int) -> ChunkOptions:
        """Chunks of ``max_tokens`` that overlap by a fifth of it."""
        return cls(max_tokens=max_tokens, overlap=max_tokens // 5)


def _too_long(text: Column, tokens: int) -> Column:
    return F.octet_length(text) >= 4 * (tokens + 1)


def _tail(text: Column, overlap: int) -> Column:
    ws = F.filter(F.split(text, _WORD_GAP), lambda w: w != "")
    return F.when(F.size(ws) <= overlap, text).otherwise(F.array_join(F.slice(ws, F.greatest(F.size(ws) - overlap + 1, F.lit(1)), F.lit(overlap)), " "))


def _packed(parts: Column, glue: str, tokens: int) -> Column:
    """Parts joined by ``glue`` as long as they stay within ``tokens``."""
    return _buffers(F.filter(parts, lambda p: p != ""), glue, tokens, lambda _, p: p)


def _buffers(parts: Column, glue: str, tokens: int, begin) -> Column:
    """Parts in buffers joined by ``glue`` as long as they stay within ``tokens``; ``begin`` (last buffer, part): the next one's beginning."""
    none = F.array().cast("array<string>")

    def step(held: Column, p: Column) -> tuple[Column, Column]:
        joined = F.concat(held, F.lit(glue), p)
        full = (held != "") & _too_long(joined, tokens)
        return F.when(held == "", p).when(full, begin(held, p)).otherwise(joined), F.when(full, F.array(held)).otherwise(none)

    return folded(parts, "string", F.lit(""), step, lambda held: F.when(held == "", none).otherwise(F.array(held)))


def _within(text: Column, tokens: int) -> Column:
    """``text`` in pieces of at most ``tokens``, by sentences, then by words."""
    by_sentence = _packed(sentences(text), " ", tokens)
    pieces = F.flatten(F.transform(by_sentence, lambda s: F.when(_too_long(s, tokens), _packed(F.split(s, _WORD_GAP), " ", tokens)).otherwise(F.array(s))))
    return F.when(_too_long(text, tokens), pieces).otherwise(F.array(text))


def chunks(text: Column, options: ChunkOptions = ChunkOptions()) -> Column:
    """The chunks of a text in order; null and empty texts have none."""
    parts = F.filter(F.transform(F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), options.separator), clean_edges), lambda p: p != "")
    glue = "\n\n"

    def carried(b: Column, p: Column) -> Column:
        return let(_tail(clean_edges(b), options.overlap), lambda t: F.when(t == "", p).otherwise(F.concat(t, F.lit(glue), p)))

    buffers = _buffers(parts, glue, options.max_tokens, carried)
    return F.flatten(F.transform(buffers, lambda b: _within(clean_edges(b), options.hard_tokens)))


def chunk_documents(docs: DataFrame, options: ChunkOptions = ChunkOptions(), id_column: str = "id", text_column: str = "text") -> DataFrame:
    """id, document_id, chunk_index, text: one row for each chunk; the id is a hash of the document's and the index."""
    each = docs.select(F.col(id_column).alias("document_id"), F.posexplode(chunks(F.col(text_column), options)).alias("chunk_index", "text"))
    return each.select(F.sha2(F.concat_ws("|", "document_id", "chunk_index"), 256).alias("id"), "document_id", "chunk_index", "text")
