"""N-gram Jaccard join by chosen paths.

A document is the set of its distinct five-word shingles (of one to four words: all of them as one shingle). Documents of
equal sets form one class and are a single set from there on, so copies cost nothing and are never paired.

A run starts with all sets in one bucket. It samples tokens that sets share: in every bucket a set picks the two of its
tokens that come first in the order of a hash of the run and the level, and goes to the bucket of each. Two sets of
similarity 0.8 agree on at least one of the two with probability 0.96 at each level. Buckets of one set go, buckets of at
most ``LEAF`` sets are compared by brute force, larger ones are split again. A large bucket whose sets resemble each other
on average isn't worth splitting: all of it is to be compared. Its average similarity takes one pass and no pair: every
set carries one bit of each of its signatures, and sums of bits say how often two sets of the bucket agree. Runs are
repeated until a pair of similarity 0.8 meets with probability of at least ``RECALL`` wherever it lies, that is, even if
all its buckets are large on every level.

Sets that look alike (signatures of the picked tokens, sizes) are joined to candidate components, a crowd of sets that
resemble each other at once, and so is a bucket that is still large on the last level. Within a component pairs are
compared exactly, in pairs of blocks, by matrix products over shared tokens. A large component is split once more, on the
tokens that fewest of its sets have: two sets of similarity 0.8 share one of each one's first fifth, so what a crowd has in
common brings nobody together, and a crowd of any size costs about as much as its sets are many. A group of near copies is
compared as a whole, since nearly all of its pairs are links. A block is one row of at most about ``BLOCK`` sets and ``BLOCK_TOKENS`` tokens (of one set, if
that has more), and no pair of sets becomes a row: a block pair gives each of its sets the number of its links and the
root of what it is linked to. Everything that tasks hold is bounded by two blocks; what is decided between steps is a
table in the shared folder.

Defined cases: null and empty texts and texts without words have no set, no link and a class of their own; equal sets are
linked with similarity 1; repeated rows are documents like others (and copies of each other); a null doc_id stays null
and is no class's name while there is another; doc_id is a whole number or a string of one; a text of any length is a set
of its own size, and the largest one bounds a task's memory from below; ties go to the smaller doc_id, null last; classes have
columns of their own only, whatever the documents' are called, and ``one_of_each`` returns the documents' as they are; an
empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import NEAR, SHINGLE, discard, mapped, written

LEVELS = 6
PICKS = 2
#: The least probability with which two sets of similarity NEAR meet in a bucket that is compared.
RECALL = 0.999


def missed(near: float = NEAR, levels: int = LEVELS) -> float:
    """The probability that a run parts two sets of this similarity on one of so many levels, at most.

    They part on a level if no pick is shared. That is likeliest if one set holds the other: the other's picks are then both
    among what only it has. A level's picks are the same on all paths of a run, so paths don't help each other.
    """
    return 1 - (1 - (1 - near) ** PICKS) ** levels


RUNS = math.ceil(math.log(1 - RECALL) / math.log(missed()))
#: Sets and tokens of a block; two blocks are compared in one task, so a bucket of no more sets needs no splitting.
BLOCK = 256
BLOCK_TOKENS = 1 << 18
LEAF = 2 * BLOCK
#: Rows that a task compares, about.
TASK_ROWS = 1 << 14
#: Sets up to which those whose texts are needed are sent to the documents; beyond, both are dealt out.
MOST_SENT = 200_000
#: Average similarity from which a large bucket is compared as it is: splitting hardly thins it, since two of its sets share
#: one of their two picks more often than not, on every level, and its pairs of similarity NEAR are a good part of all.
DENSE = 0.5
#: Signatures (one token for each run and level) that agree, at least, where two sets are worth an exact comparison.
ALIKE = 4 * RUNS * LEVELS // 9
#: Times that a component's pairs must outnumber those of its buckets, for these to be compared.
WORTH = 2
CACHE_WORDS = 500_000

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_RNG = np.random.default_rng(20_240_601)
_MULTIPLY = _RNG.integers(1 << 62, 1 << 63, RUNS * LEVELS, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, RUNS * LEVELS, dtype=np.uint64)
_PLACES = _RNG.integers(1 << 62, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()


def token_set(text: bytes | None) -> np.ndarray:
    """The distinct shingles' 64-bit hashes, ascending."""
    found = _WORD.findall((text or b"").lower())
    if not found:
        return np.empty(0, dtype=np.uint64)
    if len(_words) > CACHE_WORDS:
        _words.clear()
    h = np.array(list(map(_words.__getitem__, found)), dtype=np.uint64)
    if len(h) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), seed=1)], dtype=np.uint64)
    s = np.zeros(len(h) - SHINGLE + 1, dtype=np.uint64)
    for k in range(SHINGLE):
        s = (s ^ (s >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : len(h) - SHINGLE + 1 + k] * _PLACES[k]
    return np.unique(s ^ (s >> np.uint64(32)))


def picks(tokens: np.ndarray) -> np.ndarray:
    """The tokens that a set picks at each run and level: RUNS * LEVELS rows of PICKS (the only token of a set twice)."""
    order = (tokens[None, :] ^ _ADD[:, None]) * _MULTIPLY[:, None]
    order ^= order >> np.uint64(31)
    rows = np.arange(len(order))
    out = np.empty((len(order), PICKS), dtype=np.uint64)
    for k in range(PICKS):
        at = order.argmin(axis=1)
        out[:, k] = tokens[at]
        if len(tokens) > k + 1:
            order[rows, at] = np.uint64(0xFFFFFFFFFFFFFFFF)
    return out


def mixed_signatures(first_picks: np.ndarray) -> np.ndarray:
    """Hashes of RUNS * LEVELS signatures; 16 bits of each are its mark."""
    mixed = first_picks * _MULTIPLY
    mixed ^= mixed >> np.uint64(33)
    return mixed * _PLACES[0]


def one_bit_each(mixed: np.ndarray) -> int:
    """A bit of each signature: unlike signatures agree in it as often as not."""
    return int((mixed >> np.uint64(17) & np.uint64(1)) @ (np.uint64(1) << np.arange(len(mixed), dtype=np.uint64)))


def average_similarity(count: Column, bits: Column) -> Column:
    """Aggregate: of two sets of a group, from how often their bits agree."""
    ones = [F.sum(F.shiftright(bits, i).bitwiseAND(F.lit(1))).cast("double") / count for i in range(RUNS * LEVELS)]
    agree = sum((o * o + (1 - o) * (1 - o) for o in ones[1:]), ones[0] * ones[0] + (1 - ones[0]) * (1 - ones[0])) / len(ones)
    return 2 * agree - 1


def _binary(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def described(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, set_key (null: no words), n, picks, marks (little-endian), bits of each document: one row each."""
    names = ["doc_id", "text_key", "set_key", "n", "picks", "marks", "bits"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                keys, sizes, chosen, marks, bits = [], [], [], [], []
                for t in _binary(part.column(2)):
                    s = token_set(t)
                    own = picks(s) if len(s) else None
                    keys.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sizes.append(len(s))
                    chosen.append(own.tobytes() if len(s) else None)
                    mixed = mixed_signatures(own[:, 0]) if len(s) else None
                    marks.append((mixed >> np.uint64(48)).astype("<u2").tobytes() if len(s) else None)
                    bits.append(one_bit_each(mixed) if len(s) else None)
                columns = pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(chosen, pa.binary()), pa.array(marks, pa.binary()), pa.array(bits, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=names)

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return mapped(asked, run, "doc_id long, text_key long, set_key binary, n long, picks binary, marks binary, bits long")


def _pick(run: int, level: int, k: int):
    at = 8 * PICKS * (run * LEVELS + level) + 8 * k
    return F.expr(f"substring(picks, {at + 1}, 8)")


def _in_blocks(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Blocks of the groups' rows, each once for every block pair of its group: key, one and two (the pair), own, rows.

    ``rows``: key, set_key, ``columns`` and __n, the number of the group's blocks.
    """
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("set_key", F.lit(5)), F.col("__n")).cast("int"))
    blocks = dealt.groupBy(key, "own", "__n").agg(F.array_sort(F.collect_list(F.struct("set_key", *columns))).alias("rows"))
    paired = blocks.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    paired = paired.select(key, F.least("own", "__other").alias("one"), F.greatest("own", "__other").alias("two"), "own", "rows")
    return paired.repartition(key, "one", "two").sortWithinPartitions(key, "one", "two", "own")


Compare = Callable[[np.ndarray, list[pa.Array]], pa.RecordBatch | None]


def _compared(rows: DataFrame, n_rows: int, key: str, columns: list[str], n_blocks: Column, compare: Compare, schema: str) -> DataFrame:
    """What ``compare`` gives for each group of one block, row by row, and for each block pair of the others.

    It gets a square matrix of the pairs of rows that it is to answer for, and set_key and ``columns`` of the rows.
    ``n_blocks`` is the same for all rows of a group. Tasks follow from ``n_rows``, how many rows there are, since comparing
    them takes much longer than their bytes would say.
    """
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // TASK_ROWS))
    placed = rows.withColumn("__n", n_blocks.cast("int"))
    whole = placed.filter("__n = 1").select(key, "set_key", *columns).repartition(tasks, key).sortWithinPartitions(key, "set_key")

    def run(groups: Callable) -> Callable:
        return lambda batches: (out for g in groups(batches) if (out := compare(*g)) is not None)

    return mapped(whole, run(_groups), schema).unionByName(mapped(_in_blocks(placed.filter("__n > 1"), key, columns), run(_pairs), schema))


def leaves(sets: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(path, set_key, count of the buckets whose sets are to be compared; a, b: sets and the crowds that they are in; the tables that they read).

    ``sets``: set_key, picks, bits of distinct sets.
    """
    found, crowds, tables = [], [], []

    def own_picks(level: int) -> Column:
        return F.array_distinct(F.array(*[F.struct(F.lit(r).alias("run"), _pick(r, level, k).alias("token")) for r in range(RUNS) for k in range(PICKS)]))

    first = sets.select("set_key", "bits", F.explode(own_picks(0)).alias("t"))
    rows = first.select("set_key", "bits", "t.run", F.xxhash64("t.run", "t.token").alias("path"))
    for level in range(1, LEVELS + 1):
        sized = rows.groupBy("run", "path").agg(F.count("*").alias("count"), average_similarity(F.count("*"), F.col("bits")).alias("similarity")).filter(F.col("count") > 1)
        # a table of its own, so that Spark can split the rows of a frequent token's bucket in the join
        counts = written(sized.withColumn("crowd", (F.col("count") > LEAF) & (F.col("similarity") >= DENSE)).drop("similarity"), f"counts{level}")
        kept = written(rows.join(counts, ["run", "path"]), f"level{level}")
        discard(counts, rows)
        tables.append(kept)
        # a crowd is a node of its own, which all its sets are connected with, and so is what is large on the last level
        crowds.append(kept.filter(F.col("crowd") | F.lit(level == LEVELS) & (F.col("count") > LEAF)).select(F.col("set_key").alias("a"), F.unhex(F.lpad(F.hex("path"), 16, "0")).alias("b")))
        large = kept.filter((F.col("count") > LEAF) & ~F.col("crowd"))
        last = level == LEVELS
        found.append(kept.filter(F.col("count") <= LEAF).select("path", "set_key", "count"))
        if last or large.isEmpty():
            break
        if level == 1:  # what is split on any further level is among these
            pool = written(sets.select("set_key", "picks").join(large.select("set_key").distinct(), "set_key", "left_semi"), "pool")
            tables.append(pool)
        own = F.explode(F.filter(own_picks(level), lambda t: t["run"] == F.col("run"))).alias("t")
        children = large.join(pool, "set_key").select("set_key", "bits", "run", "path", own)
        rows = written(children.select("set_key", "bits", "run", F.xxhash64("path", "t.token").alias("path")), f"children{level}")
    return reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, crowds), tables


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
    """(pairs to answer for, columns) of the rows of each group, from batches sorted by their first column; groups are bounded."""
    held: list[pa.RecordBatch] = []
    last = None

    def joined() -> tuple[np.ndarray, list[pa.Array]]:
        whole = pa.Table.from_batches(held)
        return ~np.eye(len(whole), dtype=bool), [c.combine_chunks() for c in whole.columns[1:]]

    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(0).to_numpy(zero_copy_only=False)
        if last is not None and keys[0] != last:
            yield joined()
            held = []
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), b.num_rows]
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            held.append(b.slice(a, z - a))
            if z < b.num_rows:
                yield joined()
                held = []
        last = keys[-1]
    if held:
        yield joined()


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
    """(pairs to answer for, columns) of the rows of each block pair, from batches of _in_blocks()."""
    last, held = None, []

    def joined() -> tuple[np.ndarray, list[pa.Array]]:
        own, rows = np.repeat([own for own, _ in held], [len(rows) for _, rows in held]), pa.concat_arrays([rows for _, rows in held])
        # of two blocks what lies across them, of a block with itself all but the diagonal
        asked = own[:, None] != own[None, :] if last[1] != last[2] else ~np.eye(len(own), dtype=bool)
        return asked, [rows.field(i) for i in range(rows.type.num_fields)]

    for b in batches:
        key, one, two, own = (b.column(i).to_numpy() for i in range(4))
        blocks = b.column(4)
        for i in range(b.num_rows):
            if last is not None and last != (key[i], one[i], two[i]):
                yield joined()
                held = []
            last = key[i], one[i], two[i]
            held.append((own[i], blocks[i].values))
    if held:
        yield joined()


def _roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric relation the first row that it is connected with."""
    root = np.arange(len(linked))
    while True:
        low = np.where(linked, root[None, :], len(root)).min(axis=1)
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def alike(sets: DataFrame, buckets: DataFrame) -> DataFrame:
    """a, b (set keys): sets that look alike, as stars around the first of those that are connected in a bucket."""

    def compare(asked: np.ndarray, columns: list[pa.Array]) -> pa.RecordBatch | None:
        if len(asked) < 2:
            return None
        keys, n = columns[0].to_pylist(), columns[1].to_numpy()
        marks = np.frombuffer(b"".join(columns[2].to_pylist()), dtype="<u2").reshape(len(keys), -1)
        near = np.minimum(n[:, None], n[None, :]) >= NEAR * np.maximum(n[:, None], n[None, :])
        agree = np.zeros(near.shape, dtype=np.int16)
        for k in range(marks.shape[1]):
            agree += marks[:, None, k] == marks[None, :, k]
        root = _roots(near & (agree >= ALIKE) & asked)
        moved = np.flatnonzero(root != np.arange(len(root)))
        if not len(moved):
            return None
        return pa.RecordBatch.from_arrays([pa.array([keys[i] for i in moved], pa.binary()), pa.array([keys[i] for i in root[moved]], pa.binary())], names=["a", "b"])

    rows = buckets.join(sets, "set_key").select("path", "set_key", "count", "n", "marks")
    n_blocks = F.when(F.col("count") > LEAF, F.ceil(F.col("count") / BLOCK)).otherwise(1)
    return _compared(rows, buckets.count(), "path", ["n", "marks"], n_blocks, compare, "a binary, b binary").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: every node of an undirected graph with a node that is the same for all that it is connected with.

    In each round every node is merged into the smallest of its neighbours and itself, and edges go on between what is
    left. Nodes are hashes, so a round leaves a fraction of them and the rounds grow with the logarithm of the largest
    component; each round is a table in the shared folder.
    """
    both = written(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct(), "edges")
    labels = None
    while True:
        step = written(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("label")), "step")
        x, y = (step.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "xy")
        old, both = both, written(both.join(x, "x").join(y, "y").filter(F.col("lx") != F.col("ly")).select(F.col("lx").alias("x"), F.col("ly").alias("y")).distinct(), "edges")
        discard(old)
        if labels is None:
            labels = step
        else:
            to = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
            old, labels = labels, written(labels.join(to, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")
            discard(old, step)
        if both.isEmpty():
            discard(both)
            return labels


def shared_tokens(sets: list[np.ndarray]) -> np.ndarray:
    """How many tokens each two of the sets share: a square matrix."""
    n = list(map(len, sets))
    _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    of, shared = np.repeat(np.arange(len(n)), n), times[number] > 1
    number, of = (np.cumsum(times > 1) - 1)[number[shared]], of[shared]
    order = np.argsort(number, kind="stable")
    number, of = number[order], of[order]
    both = np.zeros((len(n), len(n)), dtype=np.float32)
    width, at = 4096, 0
    top = int(number[-1]) + 1 if len(number) else 0
    for low in range(0, top, width):
        end = int(np.searchsorted(number, low + width))
        m = np.zeros((len(n), min(width, top - low)), dtype=np.float32)
        m[of[at:end], number[at:end] - low] = 1
        both += m @ m.T
        at = end
    return both


def marked(inside: DataFrame, near: float = NEAR) -> tuple[DataFrame, DataFrame]:
    """(c, token, set_key, prefix, count, total: buckets in which all pairs of ``near`` of a large component meet; c: the components that these are worth it for).

    ``inside``: c, set_key, tokens, count of the sets of large components. In a component tokens are in order of how many of
    its sets have them. Two sets as similar as ``near`` share one of the first tokens of each, as many as can be missing and
    one more; of a crowd's sets these are what each has of its own, not what all have. Where they are shared by so many
    that the buckets hold more pairs than the component (a group of near copies), the component is compared as it is.
    """

    def exploded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sets = [np.frombuffer(t, dtype=np.int64) for t in part.column(2).to_pylist()]
                n = np.array(list(map(len, sets)), dtype=np.int64)
                of = pa.array(np.repeat(np.arange(len(sets)), n))
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets))], names=["c", "set_key", "n", "token"])

    each = mapped(inside.select("c", "set_key", "tokens"), exploded, "c long, set_key binary, n long, token long")
    common = each.groupBy("c", "token").agg(F.count("*").alias("df")).filter("df > 1")
    # tokens of one set alone come first in its order and are shared with none: they only count
    ordered = each.join(common, ["c", "token"]).groupBy("c", "set_key").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    left = F.floor((1 - near) * F.col("n") + 1e-6) + 1 - (F.col("n") - F.size("t"))
    first = F.transform(F.slice("t", F.lit(1), F.greatest(left, F.lit(0)).cast("int")), lambda x: x["token"])
    prefixes = written(ordered.select("c", "set_key", "n", first.alias("prefix")).filter(F.size("prefix") > 0), "prefixes")
    rows = prefixes.select("c", F.explode("prefix").alias("token"), "set_key", "n", "prefix")
    sized = written(rows.groupBy("c", "token").agg(F.count("*").alias("times"), F.sum("n").alias("total")), "sized")
    cost = sized.groupBy("c").agg(F.sum(F.col("times") * F.col("times")).alias("cost"))
    whole = inside.groupBy("c").agg(F.first("count").alias("count"))
    worth = whole.join(cost, "c", "left").filter(WORTH * F.coalesce("cost", F.lit(0)) <= F.col("count") * F.col("count")).select("c")
    worth = written(worth, "worth")
    kept = rows.drop("n").join(sized.filter("times > 1"), ["c", "token"]).join(worth, "c", "left_semi").withColumnRenamed("times", "count")
    return written(kept, "marked"), worth


def exact_links(inside: DataFrame, n_sets: int, near: float = NEAR) -> DataFrame:
    """set_key, n_docs, n_texts, root: links within each block pair of a component; ``n_sets``: the rows of ``inside``.

    ``inside``: component, set_key, size (documents of the set), tokens (little-endian), count and total (sets and tokens
    of the component). Of a large component the pairs that marked() brings together are compared, each where the first
    token is that both have in common there; where that isn't worth it, all.
    """

    def compare(asked: np.ndarray, columns: list[pa.Array]) -> pa.RecordBatch | None:
        keys, size = columns[0].to_pylist(), columns[1].to_numpy()
        sets = [np.frombuffer(t, dtype=np.uint64) for t in columns[2].to_pylist()]
        n, both = np.array(list(map(len, sets))), shared_tokens(sets)
        linked = (both >= near * (n[:, None] + n[None, :] - both) - 1e-6) & asked
        if len(columns) > 3:
            # a pair that meets in several buckets counts in one of them
            prefixes, own = [p.as_py() for p in columns[3]], columns[4].to_numpy()
            have = list(map(set, prefixes))
            for i, j in zip(*np.nonzero(linked), strict=True):
                if next(t for t in prefixes[i] if t in have[j]) != own[i]:
                    linked[i, j] = False
        root = _roots(linked)
        some = np.flatnonzero(linked.any(axis=1))
        if not len(some):
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array([keys[i] for i in some], pa.binary()), pa.array((linked @ size)[some]), pa.array(linked.sum(axis=1)[some]), pa.array([keys[i] for i in root[some]], pa.binary())],
            names=["set_key", "n_docs", "n_texts", "root"],
        )

    named = inside.select(F.xxhash64("component").alias("c"), "set_key", "size", "tokens", "count", "total")
    buckets, worth = marked(named.filter(F.col("count") > LEAF).select("c", "set_key", "tokens", "count"), near)
    rows = named.join(worth, "c", "left_anti")
    of = named.select("set_key", "size", "tokens")
    some = buckets.join(of, "set_key").select(F.xxhash64("c", "token", F.lit(3)).alias("bucket"), "set_key", "size", "tokens", "prefix", "token", "count", "total")
    few = (F.col("count") <= LEAF) & (F.col("total") <= 2 * BLOCK_TOKENS)
    n_blocks = F.when(few, 1).otherwise(F.ceil(F.greatest(F.col("count") / BLOCK, F.col("total") / BLOCK_TOKENS)))
    schema = "set_key binary, n_docs long, n_texts long, root binary"
    by_bucket = _compared(some, buckets.count(), "bucket", ["size", "tokens", "prefix", "token"], n_blocks, compare, schema)
    return _compared(rows, n_sets, "c", ["size", "tokens"], n_blocks, compare, schema).unionByName(by_bucket)


def _texts(docs: DataFrame, wanted: DataFrame, few: bool) -> DataFrame:
    """set_key, tokens of the wanted sets, made anew from one document of each. ``wanted``: set_key, doc_id, text_key.

    ``few``: there are so few of them that they can be sent to all tasks, and texts needn't be dealt out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([token_set(t).tobytes() for t in _binary(part.column(1))], pa.binary())], names=["set_key", "tokens"])

    of = wanted.select("set_key", F.col("doc_id").alias("__doc"), F.col("text_key").alias("__text"))
    of = F.broadcast(of) if few else of
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t"))
    rows = rows.join(of, F.col("t").eqNullSafe(F.col("__text")) & F.col("doc_id").eqNullSafe(F.col("__doc")))
    return mapped(rows.select("set_key", "text").dropDuplicates(["set_key"]), run, "set_key binary, tokens binary")


def near_classes(docs: DataFrame, near: float = NEAR) -> DataFrame:
    """doc_id, text_key, class_id, copy_id, n_links, n_texts, kept of each document, one row each.

    class_id: the smallest doc_id of all documents that links lead to, over any number of steps; copy_id: the smallest of
    those with an equal set; n_links: how many other documents it is linked to (similarity of at least ``near``);
    n_texts: how many other sets; kept: whether it is its class's first (smallest doc_id, null last, then text_key).
    ``near`` is at least NEAR, which the candidates are made for.
    """
    if near < NEAR:
        raise ValueError(f"candidates are of similarity {NEAR} or more, not {near}")
    rows = written(described(docs), "sets")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    own = F.max(F.struct("n", "picks", "marks", "bits"))
    sets = rows.filter(F.col("set_key").isNotNull()).groupBy("set_key").agg(F.count("*").alias("size"), F.min(place).alias("one"), own.alias("p"))
    sets = written(sets.select("set_key", "size", "one", "p.*"), "classes")
    buckets, crowds, tables = leaves(sets.select("set_key", "picks", "bits"))
    labels = components(alike(sets.select("set_key", "n", "marks"), buckets).unionByName(crowds))
    discard(*tables)
    members = written(labels.withColumnRenamed("node", "set_key").join(sets.select("set_key", "size", "n", "one.doc_id", "one.text_key"), "set_key"), "members")
    totals = written(members.groupBy("label").agg(F.count("*").alias("count"), F.sum("n").alias("total")), "totals")
    n_sets = members.count()
    tokens = written(_texts(docs, members.select("set_key", "doc_id", "text_key"), n_sets <= MOST_SENT), "tokens")
    inside = members.join(totals, "label").select(F.col("label").alias("component"), "set_key", "size", "count", "total").join(tokens, "set_key")
    found = written(exact_links(inside, n_sets, near), "links")
    discard(labels, tokens, members, totals)
    links = found.groupBy("set_key").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_texts").alias("n_texts"))
    of = components(found.select("set_key", "root"), "set_key", "root")
    named = sets.join(of.select(F.col("node").alias("set_key"), "label"), "set_key", "left").join(links, "set_key", "left").withColumn("label", F.coalesce("label", "set_key"))
    first = named.groupBy("label").agg(F.min("one").alias("first"))
    n_links, n_texts = F.col("size") - 1 + F.coalesce("n_docs", F.lit(0)), F.coalesce("n_texts", F.lit(0))
    full = named.join(first, "label").select("set_key", "first", F.col("one.doc_id").alias("copy_id"), n_links.alias("n_links"), n_texts.alias("n_texts"))
    full = written(full, "answers")
    discard(sets, found, of)
    zero = F.lit(0).cast("long")
    kept = F.col("first").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.col("text_key").eqNullSafe(F.col("first.text_key")))
    return rows.select("doc_id", "text_key", "set_key").join(full, "set_key", "left").select(
        "doc_id",
        "text_key",
        F.coalesce("first.doc_id", "doc_id").alias("class_id"),
        F.coalesce("copy_id", "doc_id").alias("copy_id"),
        F.coalesce("n_links", zero).alias("n_links"),
        F.coalesce("n_texts", zero).alias("n_texts"),
        kept.alias("kept"),
    )


def one_of_each(docs: DataFrame, near: float = NEAR) -> DataFrame:
    """The documents, of each class only the first; of rows with the same doc_id and text one."""
    classes = written(near_classes(docs, near).select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key"), "kept"), "kept")
    gone = classes.filter(~F.col("kept")).select("__doc", "__key").distinct()
    left = docs.withColumn("__text", F.xxhash64("text"))
    left = left.join(gone, left["doc_id"].eqNullSafe(gone["__doc"]) & left["__text"].eqNullSafe(gone["__key"]), "left_anti")
    if not classes.filter("kept").groupBy("__doc", "__key").count().filter("count > 1").isEmpty():
        left = left.dropDuplicates(["doc_id", "__text"])
    return left.drop("__text")


#: The same over small tables in DuckDB, from shared shingles.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') ws FROM documents),
sh AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] END s FROM w),
keyed AS (SELECT doc_id, s, md5(array_to_string(list_sort(s), '|')) k FROM sh),
reps AS (SELECT k, min(doc_id) copy_id, count(*) size, any_value(s) s, len(any_value(s)) n FROM keyed WHERE k IS NOT NULL GROUP BY k),
tok AS (SELECT copy_id, n, unnest(s) t FROM reps),
pairs AS (SELECT a.copy_id x, b.copy_id y FROM tok a JOIN tok b ON a.t = b.t AND a.copy_id < b.copy_id GROUP BY a.copy_id, b.copy_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-6),
edges AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (SELECT copy_id x, copy_id y FROM reps UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y),
class AS (SELECT x, min(y) class_id FROM reach GROUP BY x),
links AS (SELECT e.x, sum(r.size) n_docs, count(*) n_texts FROM edges e JOIN reps r ON r.copy_id = e.y GROUP BY e.x)
SELECT k.doc_id, coalesce(c.class_id, k.doc_id) AS class_id, coalesce(r.copy_id, k.doc_id) AS copy_id, CAST(coalesce(r.size - 1 + coalesce(l.n_docs, 0), 0) AS BIGINT) AS n_links, CAST(coalesce(l.n_texts, 0) AS BIGINT) AS n_texts, coalesce(c.class_id, k.doc_id) = k.doc_id AS kept
FROM keyed k LEFT JOIN reps r ON r.k = k.k LEFT JOIN class c ON c.x = r.copy_id LEFT JOIN links l ON l.x = r.copy_id
"""
