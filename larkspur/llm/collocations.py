r"""Phrase collocation mining: the phrases of each language that are said together more often than their parts would meet.

1. Sketches: every task counts hashes of runs of 1 to ``max_words`` words in count-min sketches, which are summed slot by
   slot. A sketch never counts too little, so runs with a slot below ``min_count`` are no candidates. Runs are counted level
   by level, and a longer run only where its shorter parts may be candidates, as far as that is known. ``min_count`` is the
   same for any input, so sketches grow with the bytes of the texts (up to ``MOST_SLOTS``): full ones would leave all runs.
2. Candidates: what all sketches leave is put out as sets, a task's and then all.
3. Automata: candidates are dealt into blocks of at most about ``MOST_KEYS`` bytes, of one language or of several small
   ones, each of which becomes an Aho-Corasick automaton for each language. A word is three signs in it, so it has few
   nodes for a candidate, since what a candidate begins with is mostly one too. Every shard of the texts of the block's
   languages runs through it and counts all matches, also overlapping ones; the counts are summed.
4. Only then the threshold is applied, so the result is exact however full the sketches were. Cuts, scores and what longer
   phrases hold are joins of the counted phrases.

What is sent to all tasks is bounded: the sketches' bits, and one block of candidates. Numbers of a score may pass 64 bits:
they are decimals of 38 digits.

Defined cases: a null text is an empty one, which has no words; a null language is ``und``; phrases don't cross the signs
.,;:!? nor line feeds and the like; blanks and tabs part words, however many; repeated rows count as often as they stand;
texts of any length are read whole; other columns are dropped, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import batched, islice
from math import ceil
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import discard, mapped, written

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
#: A phrase goes if a longer one that holds it is at least so many per cent as frequent.
HELD_SHARE = 100
#: Slots of a sketch's row (powers of two): the least and most, and the bytes of texts for each between; and its rows.
SLOTS = 1 << 23
MOST_SLOTS = 1 << 26
SLOT_BYTES = 128
ROWS = 2
#: Slots that are summed as one row.
RANGE = 1 << 16
#: Bytes of the candidates that are compiled at once, and words of a text that run through an automaton at once.
MOST_KEYS = 16 << 20
MOST_WORDS = 1 << 19
#: Bytes of texts whose words are hashed at once, phrases that a task keeps, and rows that are put out at once.
CHUNK = 2 << 20
MOST_SEEN = 1_000_000
MOST_ROWS = 50_000
#: Parts of the hashes by which candidates are united, and phrases whose counts are one row.
PARTS = 1024
COUNTS = 1 << 14

_LOWERED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0a\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n\n")
_ODD = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def words_of(text: str | None) -> list[list[bytes]]:
    """The words of each of a text's pieces that has some."""
    return [ws for p in (text or "").encode().translate(_LOWERED).split(b"\n") if (ws := p.split())]


def normalized(text: str | None) -> tuple[bytes, int]:
    """A text's pieces, parted by line feeds, with one blank on both sides of every word; and how many words it has."""
    pieces = words_of(text)
    return b"\n".join([b" " + b" ".join(ws) + b" " for ws in pieces]), sum(map(len, pieces))


def _mixed(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _power(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        both = [np.full(n, b, dtype=np.uint64) for b in (_ODD, pow(_ODD, -1, 1 << 64))]
        for x in both:
            x[0] = 1
        _powers[:] = map(np.cumprod, both)
    return _powers


class Words:
    """Words of some normalized texts: where each begins and ends, and hashes of the runs that begin with it."""

    def __init__(self, texts: list[bytes], langs: list[str], counts: list[int]):
        self.data = b"\n".join(texts)
        self.langs, self.of_text = langs, np.repeat(np.arange(len(texts)), counts)
        a = np.frombuffer(self.data, dtype=np.uint8)
        apart = np.concatenate([[True], (a == 32) | (a == 10), [True]])
        edges = np.flatnonzero(apart[1:] != apart[:-1])
        self.begin, self.end = edges[::2], edges[1::2]
        self.piece = np.cumsum(a == 10)[self.begin] if len(a) else np.zeros(0, dtype=np.int64)
        up, down = _power(max(CHUNK, len(a)) + 1)
        sums = np.zeros(len(a) + 1, dtype=np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=sums[1:])
        seeds = {lang: np.uint64(int.from_bytes(lang.encode()[:64], "little") * _ODD % (1 << 64)) for lang in set(langs)}
        self.one = _mixed(((sums[self.end] - sums[self.begin]) * down[self.begin]) ^ np.array([seeds[x] for x in langs], dtype=np.uint64)[self.of_text])
        self.runs = {1: self.one}
        self.lives = {0: np.ones(len(self.one) + 1, dtype=bool)}

    def hashes(self, k: int) -> np.ndarray:
        """Of the run of ``k`` words from each word on (but the last ones)."""
        if k not in self.runs:
            n = max(0, len(self.one) - k + 1)
            self.runs[k] = _mixed(self.hashes(k - 1)[:n] * np.uint64(_ODD) + self.one[k - 1 :])
        return self.runs[k]

    def together(self, k: int) -> np.ndarray:
        n = max(0, len(self.one) - k + 1)
        return self.piece[:n] == self.piece[k - 1 :] if n else np.zeros(0, dtype=bool)

    def live(self, k: int, flags: dict[int, np.ndarray]) -> np.ndarray:
        """True where a run of ``k`` words may be a candidate, by the levels that ``flags`` (always the same ones) has."""
        if k not in self.lives:
            below, n = self.live(k - 1, flags), max(0, len(self.one) - k + 1)
            out = self.together(k) & below[:-1][:n] & below[1:][:n]
            if k in flags:
                at = np.flatnonzero(out)
                out[at] = _above(flags[k], self.hashes(k)[at])
            self.lives[k] = out
        return self.lives[k]


def _slots(h: np.ndarray, row: int, slots: int) -> np.ndarray:
    return ((h >> np.uint64(32 * row)) & np.uint64(slots - 1)).astype(np.int64)


def _above(flags: np.ndarray, h: np.ndarray) -> np.ndarray:
    """True where every row of the sketch has counted enough; ``flags``: rows of bits."""
    slots = flags.shape[1] * 8
    found = np.ones(len(h), dtype=bool)
    for row in range(len(flags)):
        s = _slots(h, row, slots)
        found &= (flags[row][s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1
    return found


def _words(batches: Iterable[pa.RecordBatch]) -> Iterator[Words]:
    """The words of texts (lang, text), of about CHUNK bytes at a time."""
    texts, langs, counts, held = [], [], [], 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            norm, n = normalized(text.as_py())
            if n:
                texts.append(norm)
                langs.append(lang)
                counts.append(n)
                held += len(norm)
            if held >= CHUNK:
                yield Words(texts, langs, counts)
                texts, langs, counts, held = [], [], [], 0
    if texts:
        yield Words(texts, langs, counts)


def _parts(counters: np.ndarray, most: int) -> Iterator[tuple[int, bytes]]:
    """(range, counts) of a sketch's row, cut off above ``most``; where few slots have any, as their places and counts."""
    kind = np.min_scalar_type(most)
    for r in range(0, len(counters), RANGE):
        c = np.minimum(counters[r : r + RANGE], np.iinfo(kind).max).astype(kind)
        at = np.flatnonzero(c)
        if len(at) * (2 + c.itemsize) < c.nbytes:
            if len(at):
                yield r // RANGE, b"\0" + at.astype("<u2").tobytes() + c[at].tobytes()
        else:
            yield r // RANGE, b"\1" + c.tobytes()


def _add_part(total: np.ndarray, data: bytes, most: int) -> None:
    kind = np.min_scalar_type(most)
    if data[0]:
        total += np.frombuffer(data, dtype=kind, offset=1)
    else:
        n = (len(data) - 1) // (2 + kind.itemsize)
        total[np.frombuffer(data, dtype="<u2", count=n, offset=1)] += np.frombuffer(data, dtype=kind, count=n, offset=1 + 2 * n)


def slots_for(size: int) -> int:
    """Slots of a sketch's row for texts of so many bytes."""
    return min(MOST_SLOTS, max(SLOTS, 1 << (size // SLOT_BYTES).bit_length()))


def sketched(docs: DataFrame, levels: tuple[int, ...], known: dict[int, np.ndarray], min_count: int = MIN_COUNT, slots: int = SLOTS) -> dict[int, np.ndarray]:
    """For each of ``levels`` the bits of the slots that runs of so many words may have filled to ``min_count``."""
    sent = docs.sparkSession.sparkContext.broadcast(known)
    schema = "level int, row int, part int, data binary"

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # counts stop at the kind's greatest, which is min_count at least
        kind = np.min_scalar_type(min_count)
        counters = {k: np.zeros((ROWS, slots), dtype=kind) for k in levels}
        for w in _words(batches):
            for k in levels:
                h = w.hashes(k)[w.live(k, sent.value)]
                for row in range(ROWS):
                    s, times = np.unique(_slots(h, row, slots), return_counts=True)
                    counters[k][row][s] = np.minimum(counters[k][row][s] + times, np.iinfo(kind).max)
        for k in levels:
            for row in range(ROWS):
                for part, data in _parts(counters[k][row], min_count):
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in (k, row, part)] + [pa.array([data], pa.binary())], names=["level", "row", "part", "data"])

    def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for *key, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                _add_part(sums.setdefault(tuple(key), np.zeros(min(RANGE, slots), dtype=np.uint32)), data, min_count)
        for key, s in sums.items():
            bits = np.packbits(s >= min_count, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in key] + [pa.array([bits], pa.binary())], names=["level", "row", "part", "data"])

    flags = {k: np.zeros((ROWS, slots // 8), dtype=np.uint8) for k in levels}
    # a bit a slot: at most as many as MOST_SLOTS allows, whatever the input
    for r in mapped(mapped(docs, count, schema).repartition("level", "row", "part"), total, schema).collect():
        bits = np.frombuffer(r.data, dtype=np.uint8)
        at = r.part * min(RANGE, slots) // 8
        flags[r.level][r.row][at : at + len(bits)] = bits
    sent.unpersist()
    return flags


def candidates(docs: DataFrame, flags: dict[int, np.ndarray]) -> DataFrame:
    """lang, phrase: all runs of words that the sketches don't rule out, once.

    A task's phrases leave it as sets, one for each language and part of the hashes, and sets of a part are united.
    """
    sent = docs.sparkSession.sparkContext.broadcast(flags)
    schema = "lang string, part int, phrases string"

    def sets(found: dict[tuple, list[str]]) -> Iterator[pa.RecordBatch]:
        for keys in batched(found, 64):
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array(["\n".join(found[k]) for k in keys], pa.string())], names=["lang", "part", "phrases"])
        found.clear()

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        found: dict[tuple, list[str]] = {}
        for w in _words(batches):
            for k in sent.value:
                at = np.flatnonzero(w.live(k, sent.value))
                h, first = np.unique(w.hashes(k)[at], return_index=True)
                for x, i in zip(h.tolist(), at[first].tolist(), strict=True):
                    if x not in seen:
                        seen.add(x)
                        # a line feed stands in no phrase
                        found.setdefault((w.langs[w.of_text[i]], x % PARTS), []).append(w.data[w.begin[i] : w.end[i + k - 1]].decode())
            if len(seen) > MOST_SEEN:
                seen.clear()
                yield from sets(found)
        yield from sets(found)

    def unite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        united: dict[str, set[str]] = {}
        for b in batches:
            for lang, phrases in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                united.setdefault(lang, set()).update(phrases.split("\n"))
        for lang, phrases in united.items():
            for some in batched(phrases, MOST_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.string())], names=["lang", "phrase"])

    return written(mapped(mapped(docs, find, schema).repartition("lang", "part"), unite, "lang string, phrase string"), "candidates")


class _Signs(dict):
    """Three characters for each word, each of an alphabet of its own; any other word and what parts pieces is "\\0".

    Alphabets are small, since an automaton tries what may follow one by one.
    """

    def __init__(self, words: Iterable[bytes]):
        found = sorted(set(words))
        size = max(1, ceil(len(found) ** (1 / 3)))
        first, second, third = ([chr(1 + 1000 * k + d) for d in range(size + 1)] for k in range(3))
        super().__init__((w, first[i // size // size] + second[i // size % size] + third[i % size]) for i, w in enumerate(found))

    def __missing__(self, word: bytes) -> str:
        return "\0"


def signs(pieces: list[list[bytes]], of: _Signs) -> str:
    """A text's words as signs."""
    return "\0".join(["".join(map(of.__getitem__, ws)) for ws in pieces])


class _Automata:
    """Automata of a block's languages and their words' signs, made when they are first needed; a process keeps one block's."""

    name, made = None, {}

    @classmethod
    def of(cls, name: str, lang: str, phrases: list[str]):
        if cls.name != name:
            cls.name, cls.made = name, {}
        if lang not in cls.made:
            import ahocorasick

            keys = [p.encode().split(b" ") for p in phrases]
            of = _Signs(w for ws in keys for w in ws)
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, ws in enumerate(keys):
                automaton.add_word(signs([ws], of), i)
            automaton.make_automaton()
            cls.made[lang] = automaton, of
        return cls.made[lang]


def matches(docs: DataFrame, block: dict[str, list[str]], name: str) -> DataFrame:
    """lang, phrase, n: how often the texts hold each phrase of a block, overlaps included, and all words of its languages, as "" .

    A task's counts leave it as arrays over ranges of the block's phrases, which are added up range by range.
    """
    sent = docs.sparkSession.sparkContext.broadcast(block)
    schema = "lang string, part int, counts binary"

    def row(lang: str, part: int, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([part], pa.int32()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], names=["lang", "part", "counts"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {lang: np.zeros(len(phrases), dtype=np.int64) for lang, phrases in sent.value.items()}
        words: dict[str, int] = {}
        held: dict[str, list[str]] = {}
        sizes: dict[str, int] = {}

        def run(lang: str) -> None:
            sizes[lang] = 0
            found = map(itemgetter(1), _Automata.of(name, lang, sent.value[lang])[0].iter("\0".join(held.pop(lang))))
            while len(some := np.fromiter(islice(found, 1 << 20), dtype=np.int64)):
                np.add.at(counts[lang], some, 1)

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if lang in counts:
                    pieces = words_of(text.as_py())
                    held.setdefault(lang, []).append(signs(pieces, _Automata.of(name, lang, sent.value[lang])[1]))
                    n = sum(map(len, pieces))
                    words[lang] = words.get(lang, 0) + n
                    sizes[lang] = sizes.get(lang, 0) + n + 1
                    if sizes[lang] >= MOST_WORDS:
                        run(lang)
        for lang in list(held):
            run(lang)
        for lang, n in words.items():
            yield row(lang, -1, np.array([n]))
        for lang, c in counts.items():
            for part in range(0, len(c), COUNTS):
                if (some := c[part : part + COUNTS]).any():
                    yield row(lang, part // COUNTS, some)

    def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for *key, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                counts = np.frombuffer(data, dtype="<i8")
                sums[tuple(key)] = sums[tuple(key)] + counts if tuple(key) in sums else counts
        for (lang, part), c in sums.items():
            phrases = sent.value[lang][part * COUNTS : (part + 1) * COUNTS] if part >= 0 else [""]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(phrases, pa.string()), pa.array(c, pa.int64())], names=["lang", "phrase", "n"])

    return mapped(mapped(docs, count, schema).repartition("lang", "part"), total, "lang string, phrase string, n long")


def _blocks(sizes: list[tuple[str, int]], most_keys: int) -> list[tuple[list[str], int, int]]:
    """(languages, part, parts) of each block, of languages with so many bytes of phrases: a part of a large one, or some small ones."""
    out, held = [], 0
    for lang, size in sorted(sizes, key=itemgetter(1, 0)):
        parts = max(1, ceil(size / most_keys))
        if parts > 1 or not out or held + size > most_keys:
            out += [([lang], part, parts) for part in range(parts)]
            held = size
        else:
            out[-1][0].append(lang)
            held += size
    return out


def counted(docs: DataFrame, wanted: DataFrame, min_count: int = MIN_COUNT, most_keys: int = MOST_KEYS) -> DataFrame:
    """lang, phrase, n: exact counts of the phrases ``wanted`` (lang, phrase), from ``min_count`` on, and of all words as "" .

    One pass over the texts of its languages for each block of phrases; languages without phrases have no rows.
    """
    # a row for each language
    sizes = [tuple(r) for r in wanted.groupBy("lang").agg(F.sum(F.octet_length("phrase") + 2)).collect()]
    parts = [docs.sparkSession.createDataFrame([], "lang string, phrase string, n long")] if not sizes else []
    for langs, part, of in _blocks(sizes, most_keys):
        own = F.col("lang").isin(langs)
        block: dict[str, list[str]] = {}
        # about most_keys bytes
        rows = wanted.filter(own & (F.pmod(F.xxhash64("lang", "phrase"), F.lit(of)) == part)).select("lang", "phrase").toArrow()
        for lang, phrase in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
            block.setdefault(lang, []).append(phrase)
        enough = (F.col("n") >= min_count) & (F.col("phrase") != "") | (F.col("phrase") == "") & (F.col("n") > 0) & F.lit(part == 0)
        # a table, so that no two blocks are in memory
        parts.append(written(matches(docs.filter(own), block, uuid.uuid4().hex).filter(enough), "counts"))
    return reduce(DataFrame.unionByName, parts)


def _run(words: str, begin: str, size: str) -> str:
    return f"array_join(slice({words}, {begin}, {size}), ' ')"


def scored(counts: DataFrame, held_share: int = HELD_SHARE) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the counted phrases of two words and more that no longer one makes needless.

    A phrase is cut where that gives the lowest score, floor(1000 * a * n / (l * r)), at the earliest of equal ones.
    """
    listed = counts.filter("phrase <> ''").select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("ws"))
    phrases = listed.filter(F.size("ws") >= 2)
    whole = counts.filter("phrase = ''").select("lang", "n")
    cuts = phrases.select("lang", "phrase", "a", "ws", F.explode(F.sequence(F.lit(1), F.size("ws") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.expr(_run("ws", "1", "cut")).alias("left"), F.expr(_run("ws", "cut + 1", "size(ws)")).alias("right"))
    part = lambda name, to: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(to))
    score = F.expr("(1000 * cast(a AS decimal(19, 0)) * cast(n AS decimal(19, 0))) div (cast(l AS decimal(19, 0)) * cast(r AS decimal(19, 0)))")
    each = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(whole, "lang").withColumn("score", score)
    best = each.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "n", "a")).alias("b")).select("lang", "phrase", "b.*")
    inner = F.expr(f"flatten(transform(sequence(2, size(ws) - 1), k -> transform(sequence(1, size(ws) - k + 1), i -> {_run('ws', 'i', 'k')})))")
    longer = phrases.filter(F.size("ws") >= 3).select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < held_share * F.col("a")))
    return kept.select("lang", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, held_share: int = HELD_SHARE, slots: int | None = None, most_keys: int = MOST_KEYS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases by score, a and phrase (by its bytes).

    ``slots``: of the sketches' rows, a power of two; by default as the texts' bytes ask for.
    """
    if min_count < 1 or max_words < 2:
        raise ValueError("a phrase has two words and stands once at least")
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    if slots is None:
        slots = slots_for(docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)
    flags: dict[int, np.ndarray] = {}
    # runs of three words and more are counted where all pairs in them may be candidates: most aren't
    for levels in ((1, 2), *(tuple(range(k, min(k + 3, max_words + 1))) for k in range(3, max_words + 1, 3))):
        flags |= sketched(docs, levels, flags, min_count, slots)
    wanted = candidates(docs, flags)
    counts = written(counted(docs, wanted, min_count, most_keys), "counted")
    discard(wanted)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(counts, held_share).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def sql(min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, held_share: int = HELD_SHARE) -> str:
    runs = " UNION ALL ".join(f"SELECT lang, unnest(list_transform(range(1, len(ws) - {k} + 2), lambda i: array_to_string(ws[i:i + {k} - 1], ' '))) phrase, {k} k FROM p" for k in range(1, max_words + 1))
    inner = " UNION ALL ".join(f"SELECT lang, unnest(list_transform(range(1, len(ws) - {k} + 2), lambda i: array_to_string(ws[i:i + {k} - 1], ' '))) phrase, a FROM c WHERE len(ws) > {k}" for k in range(2, max_words))
    return rf"""
WITH p AS (SELECT lang, list_filter(string_split(piece, ' '), lambda x: x <> '') ws FROM (SELECT coalesce(lang, 'und') lang,
  unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9), 'abcdefghijklmnopqrstuvwxyz '), '[.,;:!?\x0A-\x0D]')) piece FROM documents)),
 t AS (SELECT lang, sum(len(ws))::BIGINT n FROM p GROUP BY lang),
 f AS (SELECT lang, phrase, any_value(k) k, count(*) a FROM ({runs}) GROUP BY lang, phrase HAVING count(*) >= {min_count}),
 c AS (SELECT *, string_split(phrase, ' ') ws FROM f WHERE k >= 2),
 s AS (SELECT c.lang, c.phrase, c.a, cut, l.a l, r.a r, n, ((1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a))::BIGINT score FROM (SELECT *, unnest(range(1, k)) cut FROM c) c JOIN t ON t.lang = c.lang
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(ws[:cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(ws[cut + 1:], ' ')),
 b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
 h AS (SELECT lang, phrase, max(a) longer FROM ({inner or "SELECT lang, phrase, a FROM c WHERE false"}) GROUP BY lang, phrase),
 g AS (SELECT b.* FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE h.longer IS NULL OR 100 * h.longer < {held_share} * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM g QUALIFY rank <= {top}
"""
