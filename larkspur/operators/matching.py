"""Which of many phrases stand in which texts: an Aho-Corasick automaton of the phrases, and one pass over the texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.sources.shared import written
from larkspur.sources.shipping import mapped

#: Bytes of the phrases that are compiled at once; an automaton takes up to sixty times as many.
MOST_KEYS = 1 << 20


class _Automaton:
    """The automaton that a process has made last."""

    name, made = None, None

    @classmethod
    def of(cls, name: str, phrases: list[str]):
        if cls.name != name:
            import ahocorasick

            cls.name, cls.made = name, ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, p in enumerate(phrases):
                cls.made.add_word(p, i)
            cls.made.make_automaton()
        return cls.made


def holding(rows: DataFrame, phrases: list[str]) -> DataFrame:
    """id, phrase: each text's phrases, once, of rows (id, text); overlapping ones and those inside of others too."""
    name, sent = uuid.uuid4().hex, rows.sparkSession.sparkContext.broadcast(phrases)
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                if text and sent.value:
                    own = {p for _, p in _Automaton.of(name, sent.value).iter(text)}
                    at += [i] * len(own)
                    found += [sent.value[p] for p in own]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=["id", "phrase"])

    return mapped(rows.select("id", "text"), run, f"id {kind}, phrase string")


def phrases_in(rows: DataFrame, phrases: DataFrame, most_keys: int | None = None) -> DataFrame:
    """id, phrase of rows (id, text) and phrases (phrase), exactly as they are written; empty ones stand nowhere.

    Phrases are compiled in blocks of about ``most_keys`` bytes (MOST_KEYS), each of which takes one pass over the texts: a
    text is read once for all phrases of a block, and phrases never meet texts as pairs.
    """
    wanted = written(phrases.select("phrase").filter(F.col("phrase") != "").distinct(), "phrases")
    size = wanted.agg(F.sum(F.octet_length("phrase") + 8)).first()[0] or 0
    blocks = max(1, -(-size // (most_keys or MOST_KEYS)))

    def block(b: int) -> DataFrame:
        # about most_keys bytes
        return holding(rows, [r.phrase for r in wanted.filter(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == b).collect()])

    return block(0) if blocks == 1 else reduce(DataFrame.unionByName, [written(block(b), "found") for b in range(blocks)])
