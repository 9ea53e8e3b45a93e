r"""Fill-in-the-middle transformation: a text's parts in another order, between marks, so that a model learns to fill gaps.

A Split pre-tokenizer of the tokenizers library, whose matches are isolated, cuts a text into units and gives their offsets
in code points; nothing is trained. The number of offsets is the number of units n, and the offsets at two ranks between 0
and n cut the text into prefix, middle and suffix. What is drawn for a document (ranks, whether it is transformed, which
form) follows from the SHA-256 of seed and doc_id alone, so it is the same on every cluster and in every run.

One pass without shuffle; a task holds an Arrow batch and one text's offsets.

Defined cases: a null text is an empty one; an empty text, and one that holds a mark already, stays as it is (form
``plain``, no lengths); either part may be empty; a null doc_id draws as the empty string; rows that repeat a doc_id draw
alike; texts of any length are cut whole; other columns are dropped, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import mapped

#: A unit is a word with the white space before it, or white space at the end.
UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
SEED = 42
#: Per cent of the documents that are transformed, and of those in the suffix-first form.
RATE = 50
SPM_RATE = 80
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
#: Characters of texts that are put out at once.
MOST_CHARS = 4 << 20


@cache
def _splitter(units: str):
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(units), behavior="isolated")


def offsets(text: str, units: str = UNITS) -> np.ndarray:
    """Where units end, in code points."""
    return np.array([end for _, (_, end) in _splitter(units).pre_tokenize_str(text)] if text else [], dtype=np.int64)


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers below 2 ** 32 for a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(text: str | None, drawn: list[int], rate: int = RATE, spm_rate: int = SPM_RATE, units: str = UNITS) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix, of the middle, output) of one text."""
    text = text or ""
    ends = offsets(text, units)
    n = len(ends)
    if not text or any(mark in text for mark in MARKS) or drawn[2] % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((drawn[0] % (n + 1), drawn[1] % (n + 1)))
    a, b = (int(ends[rank - 1]) if rank else 0 for rank in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if drawn[3] % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that an output was made of: no mark stands in its parts, so each mark's first place is its own."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    one, rest = output.removeprefix(first).split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return two + middle + one if form == "spm" else one + middle + two


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, units: str = UNITS, restored: bool = False) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output; ``restored`` adds the text made again from output and form."""
    schema = SCHEMA + ", restored string" * restored
    names = [f.split()[0] for f in schema.split(", ")]
    types = [pa.string() if f.endswith("string") else pa.int64() for f in schema.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                done = transform(text.as_py(), draws(doc_id, seed), rate, spm_rate, units)
                rows.append((doc_id, *done, *([restore(done[4], done[1])] if restored else [])))
                held += len(done[4])
                if held > MOST_CHARS:
                    yield batch(rows)
                    rows, held = [], 0
            yield batch(rows)

    return mapped(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, of outputs and of the texts made again from them."""
    sha = lambda c: F.sha2(F.col(c), 256).alias(f"{c}_sha256")
    return fill_in_middle(docs, restored=True).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output"), sha("restored"))


_NUMBER = "CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), {}, 8) AS BIGINT)"

SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') u, {", ".join(f"{_NUMBER.format(8 * i + 1)} h{i + 1}" for i in range(4))} FROM documents),
f AS (SELECT *, len(u) n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END form FROM d),
r AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b FROM f),
p AS (SELECT *, coalesce(array_to_string(u[:a], ''), '') prefix, coalesce(array_to_string(u[a + 1:b], ''), '') middle, coalesce(array_to_string(u[b + 1:], ''), '') suffix FROM r),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END o FROM p)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
 sha256(o) AS output_sha256, sha256(CASE form WHEN 'plain' THEN o ELSE prefix || middle || suffix END) AS restored_sha256 FROM o
"""
