"""Edit-aware token counts: a segment tree of pre-token sizes for each document.

A document's leaves are its pre-tokens (of any script), each with its characters and tokens. Leaves lie in blocks, and a
segment tree over the blocks holds their sums. An edit replaces the characters from ``start`` to ``end``: the tree is
descended to the leaf that holds the last character before which nothing depends on the edit (``Encoder.context`` ahead of
it), the new text is cut into pre-tokens from there until one ends where an old one behind the edit did, only that stretch
is encoded again, its leaves take the old ones' place, and the sums on the paths above the blocks touched change. All sums
are made anew only when the blocks touched have grown to several times their size.

Defined cases: a null text is an empty one of 0 tokens; edits apply in the order given, each to the text that the ones
before left; positions beyond the text's end are its end, an end before its start is its start; null replacements are
empty; a pre-token of any length (a run without blanks) is one leaf; repeated rows are answered alike; an empty table gives
no rows; doc_id is a whole number or a string of one; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import mapped
from larkspur.llm.tokens import Encoder, encoder, vocabulary_path

LEAVES = 64
EDITS = "array<struct<start:bigint,end:bigint,text:string>>"


class TokenTree:
    """A text, its leaves in blocks, and the sums of characters and tokens over them."""

    def __init__(self, text: str, encode: Encoder, leaves: tuple[np.ndarray, np.ndarray] | None = None):
        self.text, self.encode, self.encoded_chars = text, encode, 0
        if leaves is None:
            leaves, self.encoded_chars = encode.leaves(text), len(text)
        self._build(*leaves)

    def _build(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        cuts = range(0, max(1, len(chars)), LEAVES)
        self.blocks = [(chars[i : i + LEAVES], tokens[i : i + LEAVES]) for i in cuts]
        self.size = 1 << max(0, (len(self.blocks) - 1).bit_length())
        if len(chars):
            sums = list(zip(np.add.reduceat(chars, cuts).tolist(), np.add.reduceat(tokens, cuts).tolist(), strict=True))
        else:
            sums = [(0, 0)]
        self.sums = [(0, 0)] * self.size + sums + [(0, 0)] * (self.size - len(self.blocks))
        self._sum_above(set(range(self.size, 2 * self.size)))

    def _sum_above(self, nodes: set[int]) -> None:
        """Sums of all nodes on the paths from these to the root."""
        while nodes := {i // 2 for i in nodes if i > 1}:
            for i in nodes:
                (a, b), (c, d) = self.sums[2 * i], self.sums[2 * i + 1]
                self.sums[i] = (a + c, b + d)

    @property
    def n_tokens(self) -> int:
        return self.sums[1][1]

    def _find(self, at: int) -> tuple[int, int, int]:
        """(block, leaf, where that leaf starts) of the character ``at``; of the text's end its last leaf."""
        at = min(at, max(0, len(self.text) - 1))
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if at >= before + self.sums[i][0]:
                before += self.sums[i][0]
                i += 1
        block = min(i - self.size, len(self.blocks) - 1)
        ends = before + np.cumsum(self.blocks[block][0])
        k = int(np.searchsorted(ends, at, side="right"))
        return (block, k, int(ends[k - 1]) if k else before) if k < len(ends) else (block, 0, before)

    def _scanned(self, text: str, low: int, block: int, leaf: int, changed: int, moved: int) -> tuple[list[int], list[int], int, int]:
        """Sizes of the pre-tokens of the new ``text`` from ``low`` on, and the first block and leaf that stay behind them.

        ``changed``: where what the edit put there ends; ``moved``: by how much what follows it has moved.
        """
        chars, tokens, at, old = [], [], low, low
        for n, t in self.encode.scan(text, low) if low < len(text) else ():
            chars.append(n)
            tokens.append(t)
            at += n
            while at >= changed and old < at - moved:
                while leaf >= len(self.blocks[block][0]):
                    block, leaf = block + 1, 0
                old += int(self.blocks[block][0][leaf])
                leaf += 1
            if at >= changed and old == at - moved:
                break
        else:  # nothing of the old text stays
            block, leaf = len(self.blocks) - 1, len(self.blocks[-1][0])
        self.encoded_chars += at - low
        return chars, tokens, block, leaf

    def edit(self, start: int, end: int, text: str | None) -> None:
        """Put ``text`` in the place of the characters from ``start`` up to ``end``."""
        start = min(max(start, 0), len(self.text))
        end, text = min(max(end, start), len(self.text)), text or ""
        new = self.text[:start] + text + self.text[end:]
        first, leaf, low = self._find(max(0, start - self.encode.context)) if start else (0, 0, 0)
        chars, tokens, last, rest = self._scanned(new, low, first, leaf, start + len(text), len(new) - len(self.text))
        self.text = new
        merged = [np.concatenate([self.blocks[first][k][:leaf], np.array(x, dtype=np.int64), self.blocks[last][k][rest:]]) for k, x in ((0, chars), (1, tokens))]
        touched = range(first, last + 1)
        if len(merged[0]) > 4 * LEAVES * len(touched):
            self._build(*(np.concatenate([*(b[k] for b in self.blocks[:first]), merged[k], *(b[k] for b in self.blocks[last + 1 :])]) for k in (0, 1)))
            return
        parts = zip(*(np.array_split(m, len(touched)) for m in merged), strict=True)
        for i, (c, t) in zip(touched, parts, strict=True):
            self.blocks[i] = c, t
            self.sums[self.size + i] = int(c.sum()), int(t.sum())
        self._sum_above({self.size + i for i in touched})

    def to_bytes(self) -> bytes:
        leaves = [np.concatenate([b[k] for b in self.blocks]) for k in (0, 1)]
        return zlib.compress(np.stack(leaves).astype("<u4").tobytes(), 1)

    @classmethod
    def from_bytes(cls, text: str, tree: bytes, encode: Encoder) -> TokenTree:
        chars, tokens = np.frombuffer(zlib.decompress(tree), dtype="<u4").reshape(2, -1).astype(np.int64)
        return cls(text, encode, (chars, tokens))


def _mapped(docs: DataFrame, schema: str, row) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    kinds = [types[f.split()[1]] for f in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = [row(r) for r in b.slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return mapped(docs, run, schema)


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text, n_tokens, tree of each document."""
    path = path or vocabulary_path()

    def row(r: dict) -> tuple:
        tree = TokenTree(r["text"] or "", encoder(path))
        return r["doc_id"], tree.text, tree.n_tokens, tree.to_bytes()

    return _mapped(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), "doc_id long, text string, n_tokens long, tree binary", row)


def apply_edits(counted: DataFrame, edits: DataFrame, path: str | None = None) -> DataFrame:
    """``counted`` (of count_tokens) after ``edits`` (doc_id, edits of type EDITS, one row for each doc_id): all documents.

    doc_id, text, n_tokens, tree, encoded_chars (characters that had to be encoded again).
    """
    path = path or vocabulary_path()

    def row(r: dict) -> tuple:
        tree = TokenTree.from_bytes(r["text"], r["tree"], encoder(path))
        for e in r["edits"] or []:
            tree.edit(e["start"] or 0, e["end"] or 0, e["text"])
        return r["doc_id"], tree.text, tree.n_tokens, tree.to_bytes(), tree.encoded_chars

    wanted = edits.select(F.col("doc_id").alias("__doc"), F.col("edits").cast(EDITS).alias("edits"))
    joined = counted.join(wanted, counted["doc_id"].eqNullSafe(wanted["__doc"]), "left").select("doc_id", "text", "tree", "edits")
    return _mapped(joined, "doc_id long, text string, n_tokens long, tree binary, encoded_chars long", row)


def cleaning_edits(text: Column) -> Column:
    """Three edits of a text: its first line goes, 16 characters in the middle become a mark, a closing line is added."""
    n = F.length(F.coalesce(text, F.lit("")))
    first = F.locate("\n", F.coalesce(text, F.lit("")))
    middle = F.floor((n - first) / 2)
    edit = lambda a, b, t: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), F.lit(t).alias("text"))
    return F.array(edit(F.lit(0), first, ""), edit(middle, middle + 16, " [edited]"), edit(F.lit(1 << 40), F.lit(1 << 40), "\nEnd of document."))


def edited_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Counts before and after cleaning_edits(): one pass, no shuffle.

    doc_id, n_chars, n_tokens, edited_chars, edited_tokens, encoded_chars.
    """
    path = path or vocabulary_path()

    def row(r: dict) -> tuple:
        tree = TokenTree(r["text"] or "", encoder(path))
        before, tree.encoded_chars = (len(tree.text), tree.n_tokens), 0
        for e in r["edits"]:
            tree.edit(e["start"], e["end"], e["text"])
        return r["doc_id"], *before, len(tree.text), tree.n_tokens, tree.encoded_chars

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", cleaning_edits(F.col("text")).alias("edits"))
    return _mapped(asked, "doc_id long, n_chars long, n_tokens long, edited_chars long, edited_tokens long, encoded_chars long", row)
