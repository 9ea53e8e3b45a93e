r"""Suffix-array dedup: every byte that a repeated window of ``threshold`` bytes covers goes, exactly.

A depth-limited radix sort of all windows (the suffixes, through ``threshold`` bytes), most significant digit first. A pass
deals windows into groups by their next digit, groups of one are dropped, and what is in one group after the last pass are
exactly the repeated windows. Windows that neighbour each other stand in one row as long as they can, since a row for each
would be many times the text:

1. The first digit of a window is its least run of ``gram`` bytes by hash (of equal ones the first): its anchor, which
   about a hundred neighbouring windows share. All of an anchor's windows are one row; they lie in the bytes around it, and
   where those bytes are equal elsewhere, all of them are repeated. Where the anchor is alone, none is.
2. Of other rows, windows are taken by blocks of their place before the anchor. A block's digit is the bytes that all its
   windows share. Alone, none of them is repeated; equal with all bytes around, all are.
3. Windows of what is left are rows of their own, and the last digit is all their bytes.

Digits are 64-bit hashes where equality only brings rows to the next pass, and 128-bit hashes where it is the verdict.
Groups are counted by aggregation, so a window that a third of all texts hold is one row a task before it is shuffled;
joins have the larger side split by Spark where a group is large. No group is ever gathered.

Defined cases: a null text is empty; texts below ``threshold`` bytes keep all; windows never cross texts, may overlap and
are judged on the input; rows that repeat a doc_id and its text are documents of their own, which repeat each other; texts
of any length are read whole, in overlapping parts; a null doc_id is a value; other columns are dropped, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import discard, mapped, written

THRESHOLD = 400
#: Bytes of a text that are looked through at once.
PART = 1 << 20
#: Bits of the table of first digits that stand more than once: what is sent to all tasks, whatever the input.
FLAGS = 1 << 25
#: Rows that are put out at once, and bytes of texts.
MOST_ROWS = 50_000
MOST_BYTES = 8 << 20

_ODD = 0x9E3779B97F4A7C15
_AT = np.uint64((1 << 21) - 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def gram_of(threshold: int) -> int:
    """Bytes of an anchor: long ones are rarely shared by chance, short ones are fewer."""
    return max(1, threshold // 3)


def block_of(threshold: int) -> int:
    """Places of windows that the second pass takes together."""
    return max(1, (threshold - gram_of(threshold)) // 8 + 1)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0][0]) < n:
        up = np.full(n, _ODD, dtype=np.uint64)
        down = np.full(n, pow(_ODD, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _powers[0] = np.cumprod(up), np.cumprod(down)
    return _powers[0]


def _mixed(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring keys."""
    out, have = keys, 1
    while 2 * have <= width:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    n = len(keys) - width + 1
    return out[:n] if have == width else np.minimum(out[:n], out[width - have : width - have + n])


def anchors(text: np.ndarray, threshold: int = THRESHOLD, part: int = PART) -> np.ndarray:
    """Of a text's bytes the rows (at, first, last, hash): an anchor's place, and the starts of the windows that it leads."""
    gram, found = gram_of(threshold), []
    part = max(part, 2 * threshold)
    for start in range(0, max(0, len(text) - threshold + 1), part):
        t = text[start : start + part + threshold - 1]
        n = len(t)
        up, down = _power(part + threshold)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((t.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        hashes = _mixed((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
        # the place in the low bits: of equal hashes the first is least
        least = (_least((hashes & ~_AT) | np.arange(len(hashes), dtype=np.uint64), threshold - gram + 1) & _AT).astype(np.int64)
        begins = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        rows = np.empty((len(begins), 4), dtype=np.int64)
        rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3] = least[begins], begins, np.append(begins[1:], len(least)) - 1, hashes[least[begins]].view(np.int64)
        rows[:, :3] += start
        if found and found[-1][-1, 0] == rows[0, 0]:
            found[-1][-1, 2], rows = rows[0, 2], rows[1:]
        if len(rows):
            found.append(rows)
    return np.concatenate(found) if found else np.empty((0, 4), dtype=np.int64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _digit(data: memoryview, seed: int) -> tuple[int, int]:
    """128 bits of some bytes, as two whole numbers."""
    h = xxhash.xxh3_128_intdigest(data, seed)
    return _signed(h >> 64), _signed(h & 0xFFFFFFFFFFFFFFFF)


def _around(data: memoryview, at: int, low: int, high: int, threshold: int) -> tuple[int, int]:
    """All bytes of windows that begin ``low`` to ``high`` bytes before ``at``, as far as the text goes, and how far that is."""
    begin, end = max(0, at - high), min(len(data), at - low + threshold)
    return _digit(data[begin:end], ((at - begin) << 24) ^ ((end - at) & 0xFFFFFF))


def _texts(column: pa.Array) -> Iterator[memoryview]:
    """The bytes of each value; of null none."""
    column = column.cast(pa.large_binary())
    offsets, data = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1], column.buffers()[2]
    whole, valid = memoryview(data or b""), column.is_valid().to_pylist()
    for i, there in enumerate(valid):
        yield whole[offsets[i] : offsets[i + 1]] if there else memoryview(b"")


def _rows_out(rows: Iterable[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Batches of rows of long columns, and ints where the schema says so."""
    names = [f.split() for f in schema.split(", ")]
    types = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[t] for _, t in names]
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = zip(*held, strict=True) if held else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=[n for n, _ in names])

    for row in rows:
        held.append(row)
        if len(held) >= MOST_ROWS:
            yield batch()
            held.clear()
    yield batch()


def _from_texts(docs: DataFrame, rows_of: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """``rows_of(text, *other columns)`` of every row, whose first column is the text."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            others = [c.to_pylist() for c in b.columns[1:]]
            for text, *rest in zip(_texts(b.column(0)), *others, strict=True):
                yield from rows_of(text, *rest)

    return mapped(docs, lambda batches: _rows_out(rows(batches), schema), schema)


def _row_key() -> list[Column]:
    """Names a row by 96 bits of its doc_id and text; rows that repeat both share verdicts."""
    return [F.xxhash64("doc_id", "text").alias("row"), (F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), "text")) - (1 << 31)).cast("int").alias("more")]


def shared_grams(docs: DataFrame, threshold: int = THRESHOLD) -> np.ndarray:
    """One bit for each remainder of an anchor's hash by FLAGS: whether an anchor that stands more than once has it.

    A filter of fixed size: set by chance, a bit costs rows in the next pass, no more.
    """

    def grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in _texts(b.column(0)):
                if len(text) >= threshold:
                    yield pa.RecordBatch.from_arrays([pa.array(anchors(np.frombuffer(text, dtype=np.uint8), threshold)[:, 3])], names=["gram"])

    counted = mapped(docs.select("text"), grams, "gram long").groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1")
    slot = F.col("gram").bitwiseAND(FLAGS - 1)
    words = counted.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(gram & 63))")).alias("bits")).toArrow()
    flags = np.zeros(FLAGS // 64, dtype=np.uint64)
    flags[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return flags


def _flagged(flags: np.ndarray, grams: np.ndarray) -> np.ndarray:
    slots = grams.view(np.uint64) & np.uint64(FLAGS - 1)
    return (flags[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63))) & np.uint64(1) == 1


def repeated_windows(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """row, more (of _row_key), first, last: runs of starts of windows that stand elsewhere too, of documents (doc_id, text)."""
    gram, width = gram_of(threshold), block_of(threshold)
    flags = docs.sparkSession.sparkContext.broadcast(shared_grams(docs, threshold))
    named = docs.select("text", *_row_key())

    # the first digit: an anchor, with all that lies around it
    def by_anchor(text: memoryview, row: int, more: int) -> Iterator[tuple]:
        if len(text) < threshold:
            return
        found = anchors(np.frombuffer(text, dtype=np.uint8), threshold)
        for at, first, last, g in found[_flagged(flags.value, found[:, 3])].tolist():
            yield (g, *_around(text, at, 0, threshold - gram, threshold), row, more, at, first, last)

    places = written(_from_texts(named, by_anchor, "gram long, u1 long, u2 long, row long, more int, at int, first int, last int"), "anchors")
    place = F.struct("row", "more", "at", "first", "last")
    kinds = written(places.groupBy("gram", "u1", "u2").agg(F.count("*").alias("n"), F.min(place).alias("p")), "kinds")
    # of an anchor with more kinds of surroundings than one, of which one stands alone
    mixed = kinds.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1").select("gram")
    whole = places.join(kinds.filter("n > 1").select("gram", "u1", "u2"), ["gram", "u1", "u2"]).select("row", "more", "first", "last")
    open_ = kinds.join(mixed, "gram").select("p.*", F.least("n", F.lit(2)).cast("int").alias("n"))

    # the second digit: what the windows of a block of places share
    def by_block(text: memoryview, row: int, more: int, asked: list[dict]) -> Iterator[tuple]:
        for x in asked:
            at, n = x["at"], x["n"]
            for b in range((at - x["last"]) // width, (at - x["first"]) // width + 1):
                low, high = b * width, min(b * width + width - 1, threshold - gram)
                first, last = max(x["first"], at - high), min(x["last"], at - low)
                core = _digit(text[at - low : at - high + threshold], b)[0]
                yield (core, *_around(text, at, low, high, threshold), row, more, at, first, last, n)

    by_row = open_.groupBy("row", "more").agg(F.collect_list(F.struct("at", "first", "last", "n")).alias("asked"))
    # rows that repeat each other are asked once: what they share is of more kinds than one
    asked = named.join(by_row, ["row", "more"]).select("text", "row", "more", "asked")
    blocks = written(_from_texts(asked, by_block, "core long, u1 long, u2 long, row long, more int, at int, first int, last int, n int"), "blocks")
    kinds2 = written(blocks.groupBy("core", "u1", "u2").agg(F.sum("n").alias("n"), F.min(place).alias("p")), "kinds")
    mixed2 = kinds2.groupBy("core").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1").select("core")
    whole2 = blocks.filter("n = 1").join(kinds2.filter("n > 1").select("core", "u1", "u2"), ["core", "u1", "u2"]).select("row", "more", "first", "last")
    open2 = kinds2.join(mixed2, "core").select("p.*", F.least("n", F.lit(2)).cast("int").alias("n"))

    # the last digit: whole windows
    def by_window(text: memoryview, row: int, more: int, asked: list[dict]) -> Iterator[tuple]:
        for x in asked:
            for s in range(x["first"], x["last"] + 1):
                yield (*_digit(text[s : s + threshold], 0), row, more, s, x["n"])

    by_row2 = open2.groupBy("row", "more").agg(F.collect_list(F.struct("first", "last", "n")).alias("asked"))
    windows = written(_from_texts(named.join(by_row2, ["row", "more"]).select("text", "row", "more", "asked"), by_window, "u1 long, u2 long, row long, more int, at int, n int"), "windows")
    equal = windows.groupBy("u1", "u2").agg(F.sum("n").alias("n")).filter("n > 1").select("u1", "u2")
    single = windows.filter("n = 1").join(equal, ["u1", "u2"]).select("row", "more", F.col("at").alias("first"), F.col("at").alias("last"))
    out = written(whole.unionByName(whole2).unionByName(single), "repeated")
    discard(places, kinds, blocks, kinds2, windows)
    flags.unpersist()
    return out


def covered(runs: list[dict], threshold: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes (begin, end) that windows starting within ``runs`` cover."""
    out: list[list[int]] = []
    for first, last in sorted((r["first"], r["last"]) for r in runs):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + threshold)
        else:
            out.append([first, last + threshold])
    return [(a, b) for a, b in out]


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary: what isn't covered may end within a character), a row for each of ``docs``.

    ``digest``: kept_sha256, the hexadecimal digest, in place of the bytes.
    """
    if threshold < 2:
        raise ValueError("a window has two bytes at least")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    runs = repeated_windows(docs, threshold).groupBy("row", "more").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    joined = docs.select("*", *_row_key()).join(runs, ["row", "more"], "left").select("text", "doc_id", "runs")

    def kept(text: memoryview, runs: list[dict] | None) -> tuple[int, int, int, list[memoryview]]:
        spans = covered(runs or [], threshold)
        ends = [0, *(x for span in spans for x in span), len(text)]
        return len(text), sum(b - a for a, b in spans), len(spans), [text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)]

    if digest:

        def one(text: memoryview, doc_id: int | None, runs: list[dict] | None) -> Iterator[tuple]:
            *numbers, parts = kept(text, runs)
            sha = hashlib.sha256()
            for p in parts:
                sha.update(p)
            yield (doc_id, *numbers, sha.hexdigest())

        return _from_texts(joined, one, DIGEST)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, doc_id, runs in zip(_texts(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                *numbers, parts = kept(text, runs)
                columns = [pa.array([x], pa.int64()) for x in (doc_id, *numbers)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([b"".join(parts)], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return mapped(joined, run, DIGEST.replace("kept_sha256 string", "kept binary"))
