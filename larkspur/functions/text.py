"""Text as column expressions: cleaning, tags, tokens, sentences, paragraphs, token estimates.

Everything here is native; nothing leaves the JVM. Lengths are octets where the function says so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: White space that collapses: tab, line feed, form feed, carriage return, space.
BLANKS = r"[\t\n\f\r ]+"
#: What separates words: ASCII but letters and digits; other punctuation, symbols, separators and controls, which are only
#: looked up for what isn't ASCII.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F[\x{80}-\x{10FFFF}&&[\p{P}\p{S}\p{Z}\x{80}-\x{9F}]]]+"
CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"
#: What separates words of a text that is ASCII only.
_NOT_ASCII_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Signs of CJK lie here; to look for ranges is quick, to look up scripts isn't.
_MAY_BE_CJK = r"[\x{1100}-\x{11FF}\x{2E80}-\x{10FFFF}]"
_EDGES = r"^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Items of a fold that are put out together.
_AT_ONCE = 256


def folded(items: Column, kind: str, start: Column, step, end=None) -> Column:
    """What a fold over an array puts out, as one array of ``kind``.

    ``start``: the first state; ``step`` (state, item): the next state and an array of what goes out; ``end`` (state): an
    array of what is left. Output is gathered in blocks, so a long array isn't copied at each of its items.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, item: Column) -> Column:
        state, out = step(acc["s"], item)
        return F.struct(F.concat(acc["o"], out).alias("o"), state.alias("s"))

    def block(xs: Column, acc: Column, b: Column) -> Column:
        inner = F.aggregate(F.slice(xs, b * _AT_ONCE + 1, F.lit(_AT_ONCE)), F.struct(none.alias("o"), acc["s"].alias("s")), one)
        return let(inner, lambda r: F.struct(F.concat(acc["o"], F.array(r["o"])).alias("o"), r["s"].alias("s")))

    def whole(xs: Column) -> Column:
        numbers = F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _AT_ONCE).cast("int"))).otherwise(F.array().cast("array<int>"))
        first = F.struct(F.array().cast(f"array<array<{kind}>>").alias("o"), start.alias("s"))
        last = lambda acc: F.flatten(acc["o"]) if end is None else F.concat(F.flatten(acc["o"]), end(acc["s"]))
        return F.aggregate(numbers, first, lambda acc, b: block(xs, acc, b), last)

    return let(items, whole)


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(c, UPPER, LOWER)


def clean_text(c: Column) -> Column:
    """Runs of white space become one space; white space of any script goes from both ends."""
    return F.regexp_replace(F.regexp_replace(c, BLANKS, " "), _EDGES, "")


def tidy_paragraphs(c: Column) -> Column:
    """Like clean_text, but blank lines stay as paragraph breaks."""
    parts = F.transform(F.split(F.regexp_replace(c, "\r\n?", "\n"), r"\n[\t ]*(?:\n[\t ]*)+"), clean_text)
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def remove_tag(c: Column, tag: str) -> Column:
    """What lies outside of ``<tag ...>`` ... ``</tag>``; nested ones count, one that is never closed takes the rest."""
    start, end = f"<{tag}", f"</{tag}>"
    parts = F.split(c, f"(?=<{tag})|(?={end})")

    def step(depth: Column, p: Column) -> tuple[Column, Column]:
        opens, closes = F.startswith(p, F.lit(start)), F.startswith(p, F.lit(end))
        now = depth + F.when(opens, 1).when(closes & (depth > 0), -1).otherwise(0)
        shown = F.when((depth == 0) & ~opens, p).when((depth == 1) & closes, F.substr(p, F.lit(len(end) + 1))).otherwise("")
        return now, F.array(shown)

    return F.when(F.contains(c, F.lit(start)), F.array_join(folded(parts, "string", F.lit(0), step), "")).otherwise(c)


def strip_tags(c: Column) -> Column:
    """Text without ``<...>`` and stray ``>``; nothing takes their place and entities stay."""
    return F.regexp_replace(F.regexp_replace(c, r"<[^>]*(?:>|$)", ""), ">", "")


def title_of(c: Column) -> Column:
    """The first title element's text, cleaned; empty without one."""
    return clean_text(F.regexp_extract(c, r"<title[^>]*>([^<]*)</title>", 1))


def html_text(c: Column) -> Column:
    return clean_text(strip_tags(remove_tag(remove_tag(c, "script"), "style")))


def json_strings(c: Column) -> Column:
    """All quoted strings of a JSON text, keys too, but those that begin with a bracket, joined by spaces."""
    found = F.regexp_extract_all(c, F.lit(r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"'), F.lit(1))
    return clean_text(F.array_join(F.filter(found, lambda s: ~s.rlike(r"^[{\[]|^$")), " "))


def yaml_values(c: Column) -> Column:
    """What follows the first colon of each line, but comments, blank lines and values that begin with a bracket."""

    def value(line: Column) -> Column:
        return F.when(~line.rlike("^#"), clean_text(F.regexp_extract(line, r"^[^:]+:(.*)$", 1))).otherwise("")

    lines = F.transform(F.split(c, "\n"), lambda x: value(clean_text(x)))
    return clean_text(F.array_join(F.filter(lines, lambda v: ~v.rlike(r"^[{\[]|^$")), " "))


def csv_values(c: Column) -> Column:
    """All fields, split at every comma, trimmed, less one pair of quotes around each."""
    bare = lambda f: F.when(f.rlike(r'(?s)^"(.*")?$'), F.substr(f, F.lit(2), F.greatest(F.length(f) - 2, F.lit(0)))).otherwise(f)
    fields = F.transform(F.split(c, r"[,\n]"), lambda f: bare(F.regexp_replace(f, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")))
    return clean_text(F.array_join(F.filter(fields, lambda f: f != ""), " "))


def rtf_text(c: Column) -> Column:
    """Control words, escapes and braces become spaces."""
    return clean_text(F.regexp_replace(c, r"\\[a-z]+\d*[\t\n\f\r ]*|\\'[0-9a-fA-F]{2}|\\[~{}]|\\\n|[{}]", " "))


def printable_runs(c: Column) -> Column:
    """Runs of four or more printable ASCII characters (of a legacy binary document), but markup prologues."""
    runs = F.regexp_extract_all(c, F.lit(r"[\x20-\x7E]{4,}"), F.lit(0))
    return clean_text(F.array_join(F.filter(runs, lambda r: ~(F.contains(r, F.lit("<?xml")) | F.contains(r, F.lit("<!DOCTYPE")))), " "))


def unfenced(c: Column) -> Column:
    """A model's answer without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def escape_like(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\%_])", r"\\$1")


def _cjk_grams(run: Column) -> Column:
    one = lambda i: F.array(F.substr(run, i, F.lit(1)), F.substr(run, i, F.lit(2)))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.length(run)), one))
    return F.slice(grams, F.lit(1), 2 * F.length(run) - 1)


def tokenize(c: Column, lower: bool = True) -> Column:
    """Words in ASCII lower case; a run of Chinese, Japanese or Korean signs gives each sign and each pair of neighbours.

    ``lower``: without it letters are as they are, for what lowers them itself.
    """
    text = F.coalesce(c, F.lit(""))
    plain = F.octet_length(text) == F.length(text)
    runs = F.array_remove(F.split(ascii_lower(text) if lower else text, NOT_WORD), "")
    parts = lambda w: F.regexp_extract_all(w, F.lit(f"{CJK}+|(?:(?!{CJK}).)+"), F.lit(0))
    split = lambda w: F.flatten(F.transform(parts(w), lambda p: F.when(p.rlike(f"^{CJK}"), _cjk_grams(p)).otherwise(F.array(p))))
    whole = let(runs, lambda r: F.when(c.rlike(_MAY_BE_CJK) & c.rlike(CJK), F.flatten(F.transform(r, split))).otherwise(r))
    # of ASCII alone the same words by simpler classes
    return F.when(plain, F.array_remove(F.split(F.lower(text) if lower else text, _NOT_ASCII_WORD), "")).otherwise(whole)


def run_lengths(items: Column, item: str = "item", times: str = "times", kind: str = "string") -> Column:
    """The distinct items of an array of ``kind``, in order, and how often each stands: (item, times)."""

    def counts(sorted_: Column) -> Column:
        n = F.size(sorted_)
        firsts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(sorted_, i) != F.get(sorted_, i - 1)))
        each = let(firsts, lambda at: F.transform(at, lambda i, j: F.struct(F.get(sorted_, i).alias(item), (F.coalesce(F.get(at, j + 1), n) - i).alias(times))))
        return F.when(n > 0, each).otherwise(F.array().cast(f"array<struct<{item}:{kind},{times}:int>>"))

    # not array_sort, whose order is a function called for every two items
    return let(F.sort_array(items), counts)


def term_counts(c: Column) -> Column:
    """The distinct tokens of a text, in order, and how often each stands (term, tf): counted within the row."""
    return run_lengths(tokenize(c), "term", "tf")


def estimated_tokens(c: Column) -> Column:
    """A quarter of the octets, rounded down."""
    return F.floor(F.octet_length(c) / 4).cast("long")


def paragraphs(c: Column) -> Column:
    return F.split(F.replace(c, F.lit("\r\n"), F.lit("\n")), "\n\n")


def sentences(c: Column) -> Column:
    """Sentences to ``.``, ``?`` or ``!``, trimmed; line feeds are spaces; what is left over is a sentence too."""
    found = F.regexp_extract_all(F.replace(c, F.lit("\n"), F.lit(" ")), F.lit(r"[^.?!]*[.?!]|[^.?!]+$"), F.lit(0))
    return F.transform(F.when(F.size(found) > 0, found).otherwise(F.array(c)), lambda s: F.trim(s))


def index_sentences(c: Column) -> Column:
    """Sentences to ``.!?`` or their full-width forms where a space or line feed follows; trimmed, none empty."""
    parts = F.split(c, r"(?<=[.!?。！？])(?=[ \n])")
    return F.filter(F.transform(parts, clean_edges), lambda s: s != "")


def clean_edges(c: Column) -> Column:
    return F.regexp_replace(c, _EDGES, "")


def index_paragraphs(c: Column, longest: int = 2000) -> Column:
    """Paragraphs, trimmed, none empty; one of more octets than ``longest`` is cut every ``longest`` characters."""

    def pieces(p: Column) -> Column:
        cuts = F.transform(F.sequence(F.lit(1), F.greatest(F.length(p), F.lit(1)), F.lit(longest)), lambda i: F.substr(p, i, F.lit(longest)))
        return F.when(F.octet_length(p) > longest, cuts).otherwise(F.array(p))

    parts = F.filter(F.transform(paragraphs(c), clean_edges), lambda p: p != "")
    return F.flatten(F.transform(parts, pieces))


def unique_strings(a: Column) -> Column:
    """Each string once, in the order of first appearance; empty ones go."""
    return F.array_distinct(F.filter(a, lambda x: x != ""))
