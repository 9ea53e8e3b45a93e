"""Cost-balanced packing of documents into training sequences.

The cost of a piece of ``n`` tokens is ``LINEAR * n + QUADRATIC * n * n`` (attention stays within a document). Documents
are packed in blocks of about ``BLOCK`` tokens as they are read. A block's tokens decide its sequences: as many whole
ones as they fill. A document longer than a sequence fills whole ones first. What is left is assigned in descending length:
each document to the sequence of lowest cost that still has room for it. One that fits nowhere is cut to fill the roomiest
sequence and goes on with its rest. What doesn't fill a sequence any more goes on with the next block; a task's last block
has sequences of power-of-two lengths for it, at most one of each length, so nothing is padded.

No row is shuffled: each task encodes and packs its own input, holds one block, and numbers its sequences by its
partition, so a task that runs again gives the same rows.

Defined cases: a null text is an empty one, whose only id is the closing one; repeated rows are packed as often as they
come; a document of any length is cut; an empty table has no pieces; doc_id is a whole number or a string of one;
of sequences that cost the same the first is taken; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from larkspur.llm.common import mapped
from larkspur.llm.tokens import encoder, vocabulary_path

LENGTH = 2048
END_ID = 1
BLOCK = 1 << 20
LINEAR = 1.0
QUADRATIC = 1.0 / 1024
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def plan(sizes: list[int], length: int = LENGTH, last: bool = True) -> tuple[list[int], list[tuple[int, int, int, int]]]:
    """(the sequences' lengths, pieces): each piece is (document, start, length, sequence) in the order of being placed.

    Unless it is the ``last`` block, up to ``length`` - 1 tokens are in no piece: the ends of some documents.
    """
    whole, rest = divmod(sum(sizes), length)
    rooms = [length] * whole + [1 << b for b in range(length.bit_length() - 1, -1, -1) if last and rest >> b & 1]
    room, load = np.array(rooms, dtype=np.int64), np.zeros(len(rooms))
    pieces, left, used = [], [], 0
    for doc, n in enumerate(sizes):
        for k in range(n // length):
            pieces.append((doc, k * length, length, used))
            room[used], load[used] = 0, cost(length)
            used += 1
        if n % length:
            left.append((n % length, doc, n - n % length))
    left.sort(key=lambda x: (-x[0], x[1]))
    free = int(room.sum())
    for n, doc, start in left:
        while n and free:
            fits = np.flatnonzero(room >= n)
            at = int(fits[np.argmin(load[fits])]) if len(fits) else int(np.argmax(room))
            take = min(n, int(room[at]))
            pieces.append((doc, start, take, at))
            room[at] -= take
            free -= take
            load[at] += cost(take)
            n, start = n - take, start + take
    return rooms, pieces


@dataclass
class Document:
    """A document's ids (little-endian), or those of its end from ``start`` on."""

    doc_id: int | None
    ids: bytes
    tokens: int
    start: int = 0


def pack_block(docs: list[Document], first_sequence: int, length: int = LENGTH, last: bool = True) -> tuple[int, list[tuple], list[Document]]:
    """The number of a block's sequences, rows of SCHEMA, and the ends of documents that the next block takes."""
    sizes = [len(d.ids) // 4 for d in docs]
    rooms, pieces = plan(sizes, length, last)
    offsets, rows, done = [0] * len(rooms), [], [0] * len(docs)
    for i, start, n, at in pieces:
        d = docs[i]
        rows.append((d.doc_id, d.start + start, n, zlib.crc32(d.ids[4 * start : 4 * (start + n)]), d.tokens, first_sequence + at, offsets[at], cost(n)))
        offsets[at] += n
        done[i] += n
    return len(rooms), rows, [Document(d.doc_id, d.ids[4 * k :], d.tokens, d.start + k) for d, k, n in zip(docs, done, sizes, strict=True) if k < n]


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """The pieces of all documents, in sequences of at most ``length`` tokens; ``path``: the vocabulary file."""
    path = path or vocabulary_path()
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    types = [pa.float64() if n == "cost" else pa.int64() for n in names]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sequence = encoder(path).ids, TaskContext.get().partitionId() << 36
        end, held, tokens = END_ID.to_bytes(4, "little"), [], 0
        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), encode(x.as_py() for x in b.column(1)), strict=True):
                held.append(Document(doc_id, ids + end, len(ids) // 4 + 1))
                tokens += held[-1].tokens
                if tokens >= block:
                    n, rows, held = pack_block(held, sequence, length, last=False)
                    yield batch(rows)
                    sequence, tokens = sequence + n, sum(len(d.ids) // 4 for d in held)
        if held:
            yield batch(pack_block(held, sequence, length)[1])

    return mapped(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), run, SCHEMA)
