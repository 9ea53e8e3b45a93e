r"""Token ids of whole texts by a byte-level BPE, and where its pre-tokens lie.

Texts are encoded by tiktoken where the same vocabulary lies beside the tokenizer's file as ranks: it gives the same ids
several times as fast. Its time grows with the square of an unbroken run, so texts with long runs are left to the
tokenizer itself.

A text is cut into pre-tokens by the published pattern, from left to right, and each is encoded by itself. Where one begins
decides all that follows, and what stands a few characters further on doesn't matter to it, so a text can be scanned anew
from any pre-token on.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from pathlib import Path

import numpy as np

#: Characters of a text that needn't be looked through, and of a run that is long.
LONG_TEXT = 4096
LONG_RUN = 500
#: Pre-tokens whose sizes a process keeps, and their characters at most.
KEPT = 500_000
KEPT_LENGTH = 64


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts by one vocabulary file, as its tokenizer gives them; a special token's string in a text is that token."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_ranks = _ranks(path)
        self.special = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.parts = pretokens(public_tokenizers.PATTERN, self.special)
        #: Characters before an edit that may decide how what stands before them is cut.
        self.context = max([3, *(len(t) + 2 for t in self.special)])
        self.sizes = _Sizes(self)

    def encode(self, text: str) -> list[int]:
        if self.by_ranks and not _long_runs(text) and not any(t in text for t in self.special):
            return self.by_ranks.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ids(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """All ids of each text as little-endian unsigned 32-bit integers; of null or empty text none."""
        for text in texts:
            yield array("I", self.encode(text)).tobytes() if text else b""

    def scan(self, text: str, start: int = 0) -> Iterator[tuple[int, int]]:
        """(characters, tokens) of the pre-tokens from ``start`` on, which is where one begins."""
        for m in self.parts.finditer(text, start):
            part = m[0]
            yield len(part), self.sizes[part]

    def leaves(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(characters, tokens) of a text's pre-tokens."""
        parts = self.parts.findall(text)
        n = len(parts)
        return np.fromiter(map(len, parts), dtype=np.int64, count=n), np.fromiter(map(self.sizes.__getitem__, parts), dtype=np.int64, count=n)


class _Sizes(dict):
    """How many tokens a pre-token has; short ones are kept."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, part: str) -> int:
        n = len(self.encoder.encode(part))
        if len(part) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                self.clear()
            self[part] = n
        return n


def pretokens(pattern: str, special: list[str]):
    """The published pattern of pre-tokens, with Unicode's white space, less and besides the strings of special tokens."""
    import regex

    pattern = pattern.replace("\\S", "\\P{White_Space}").replace("\\s", "\\p{White_Space}")
    if special:
        one = "|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True))
        # a special token ends what stands before it, as the end of the text would
        parts = [f"(?:(?!{one}){p.removeprefix(' ?').removesuffix('+')})+" if p.removeprefix(" ?").startswith("[^") else p for p in pattern.split("|")]
        parts = [f" ?{new}" if old.startswith(" ?") and old != new else new for old, new in zip(pattern.split("|"), parts, strict=True)]
        parts = [p.replace("(?!\\P{White_Space})", f"(?!(?!{one})\\P{{White_Space}})") for p in parts]
        pattern = "|".join([one, *parts])
    return regex.compile(pattern)


def _long_runs(text: str) -> bool:
    return len(text) > LONG_TEXT and (max(map(len, text.split()), default=0) > LONG_RUN or any(c * LONG_RUN in text for c in " \n\t"))


def _ranks(path: str):
    """The encoding of the ranks beside a tokenizer's file, if they are there."""
    beside = Path(path).with_suffix(".tiktoken")
    if not beside.exists():
        return None
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(token): int(n) for token, n in map(bytes.split, beside.read_bytes().splitlines())}
    return tiktoken.Encoding(beside.stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def encoder(path: str) -> Encoder:
    """One encoder a process and vocabulary."""
    return Encoder(path)
