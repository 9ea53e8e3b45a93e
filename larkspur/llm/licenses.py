r"""License scans: sentences become identifiers, identifier sequences meet ordered rules.

A text is normalised (lower case, runs of anything but a-z and 0-9 to one space, so that line wraps, comment marks and
punctuation don't matter), and what differs between copies of a license is put in one form. A known sentence is found
wherever its words stand in a row, the longest that begins at a word first; all of them are one pattern that shares the
beginnings. Fields (``License: MIT``), lines that are a license's name and lists of names are brought into the form of a
reference first; a family named without its version is an identifier of its own. The identifiers found, in order, are the text's sequence; words that belong to no known sentence break it, but
for list markers (a letter or a number of up to two digits). The rules are tried in order, longer texts before shorter
ones and before references; a rule takes the identifiers that it matches, so a three-clause text isn't a two-clause one as
well. "All rights reserved" counts only where nothing else is found.

Defined cases: a null or empty text has no license, category "none", and so has a text without known sentences; a text of
any length is read whole; repeated rows are answered alike; other columns are dropped, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import let
from larkspur.llm.license_catalog import ANCHORS, FORMS, LINE_FORMS, rules, sentences, shared

SENTENCES = sentences()
RULES = rules()
#: From the strictest on.
CATEGORIES = ("restricted", "copyleft", "permissive")
#: What may stand between two sentences of a sequence.
MARKERS = "^ (?:(?:[0-9]{1,2}|[a-z]) )*$"


PATTERN = f"(?<= ){shared([s.split() for s in SENTENCES])}(?= )"


def _pattern(ids: tuple[str, ...]) -> str:
    return "".join(f"<{i}>" for i in ids)


def normalised(text: Column) -> Column:
    """The words of a text in their one form, a space before, between and after them."""
    out = F.lower(text)
    for pattern, to in LINE_FORMS:
        out = F.regexp_replace(out, pattern, to)
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, "[^a-z0-9]+", " ")), F.lit(" "))
    for pattern, to in FORMS:
        out = F.regexp_replace(out, pattern, to)
    return out


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids (known ones), matches (array of license, category, times in the order of the rules), n_known."""
    tried = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(kind).alias("category"), F.lit(_pattern(ids)).alias("pattern")) for name, kind, ids in RULES[:-1]])
    named = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    none = F.array().cast("array<struct<license:string,category:string,times:int>>")

    def step(state: Column, rule: Column) -> Column:
        rest = F.replace(state["rest"], rule["pattern"], F.lit("|"))
        times = ((F.length(state["rest"]) - F.length(rest)) / (F.length(rule["pattern"]) - 1)).cast("int")
        hit = F.array(F.struct(rule["license"].alias("license"), rule["category"].alias("category"), times.alias("times")))
        return F.struct(rest.alias("rest"), F.when(times > 0, F.concat(state["found"], hit)).otherwise(state["found"]).alias("found"))

    def matched(ids: Column, gaps: Column) -> Column:
        sequence = F.array_join(F.transform(ids, lambda i, n: F.concat(F.when(F.get(gaps, n).rlike(MARKERS), "").otherwise("|"), F.lit("<"), i, F.lit(">"))), "")
        found = F.aggregate(tried, F.struct(sequence.alias("rest"), none.alias("found")), step, lambda s: s["found"])
        last = F.filter(ids, lambda i: F.concat(F.lit("<"), i, F.lit(">")) == _pattern(RULES[-1][2]))
        reserved = F.array(F.struct(F.lit(RULES[-1][0]).alias("license"), F.lit(RULES[-1][1]).alias("category"), F.size(last).alias("times")))
        return let(found, lambda f: F.when((F.size(f) == 0) & (F.size(last) > 0), reserved).otherwise(f))

    def scanned(words: Column) -> Column:
        ids = F.transform(F.regexp_extract_all(words, F.lit(PATTERN), F.lit(0)), lambda s: F.element_at(named, s))
        return let(ids, lambda i: F.struct(i.alias("known"), F.when(F.size(i) > 0, matched(i, F.split(words, PATTERN, -1))).otherwise(none).alias("found")))

    nothing = F.struct(F.array().cast("array<string>").alias("known"), none.alias("found"))
    text = F.coalesce("text", F.lit(""))
    each = docs.select("doc_id", F.when(F.lower(text).rlike(ANCHORS), let(normalised(text), scanned)).otherwise(nothing).alias("__s"))
    return each.select("doc_id", F.col("__s.known").alias("sentence_ids"), F.col("__s.found").alias("matches"), F.size("__s.known").cast("long").alias("n_known"))


def digest(found: DataFrame) -> DataFrame:
    category = F.coalesce(*[F.when(F.exists("matches", _is(c)), F.lit(c)) for c in CATEGORIES], F.lit("none"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",")
    return found.select("doc_id", "n_known", F.array_join("sentence_ids", ",").alias("sentence_ids"), names.alias("licenses"), category.alias("category"))


def _is(category: str):
    return lambda m: m["category"] == category


def _sql() -> str:
    """Another way to the same rows: every known sentence is looked for in every text by itself, what lies in a longer one goes."""
    known = ",\n".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    tried = ",\n".join(f"({k}, '{name}', '{kind}', '{_pattern(ids)}')" for k, (name, kind, ids) in enumerate(RULES[:-1]))
    put = lambda to: re.sub(r"[$](\d)", r"\\\1", to)
    words = "lower(coalesce(text, ''))"
    for pattern, to in LINE_FORMS:
        words = f"regexp_replace({words}, '{pattern}', '{put(to)}', 'g')"
    words = f"' ' || trim(regexp_replace({words}, '[^a-z0-9]+', ' ', 'g')) || ' '"
    for pattern, to in FORMS:
        words = f"regexp_replace({words}, '{pattern}', '{put(to)}', 'g')"
    case = " ".join(f"WHEN list_contains(kinds, '{c}') THEN '{c}'" for c in CATEGORIES)
    return rf"""
WITH RECURSIVE known(s, id) AS (VALUES {known}),
tried(k, name, kind, pattern) AS (VALUES {tried}),
norm AS (SELECT doc_id, {words} t FROM documents),
within AS (SELECT doc_id, t, s, id FROM norm JOIN known ON contains(t, ' ' || s || ' ')),
places AS (SELECT * FROM (SELECT doc_id, t, s, id, unnest(range(1, length(t) - length(s))) p FROM within) WHERE substr(t, p, length(s) + 2) = ' ' || s || ' '),
outer_ones AS (SELECT * FROM places a WHERE NOT EXISTS (SELECT 1 FROM places b WHERE b.doc_id = a.doc_id AND b.p <= a.p AND b.p + length(b.s) >= a.p + length(a.s) AND length(b.s) > length(a.s))),
spaced AS (SELECT doc_id, id, p, substr(t, lag(p + length(s) + 1, 1, 1) OVER w, p + 1 - lag(p + length(s) + 1, 1, 1) OVER w) gap FROM outer_ones WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
listed AS (SELECT doc_id, count(*) n_known, string_agg(id, ',' ORDER BY p) sentence_ids, string_agg(CASE WHEN regexp_full_match(gap, ' (([0-9]{{1,2}}|[a-z]) )*') THEN '' ELSE '|' END || '<' || id || '>', '' ORDER BY p) seq, list_contains(list(id), '{RULES[-1][2][0]}') reserved FROM spaced GROUP BY doc_id),
steps(k, doc_id, seq, names, kinds) AS (SELECT 0, doc_id, seq, []::VARCHAR[], []::VARCHAR[] FROM listed UNION ALL
 SELECT s.k + 1, doc_id, replace(seq, pattern, '|'), CASE WHEN contains(seq, pattern) THEN list_append(names, r.name) ELSE names END, CASE WHEN contains(seq, pattern) THEN list_append(kinds, kind) ELSE kinds END FROM steps s JOIN tried r ON r.k = s.k),
judged AS (SELECT doc_id, CASE WHEN len(names) = 0 AND reserved THEN ['{RULES[-1][0]}'] ELSE names END names, CASE WHEN len(names) = 0 AND reserved THEN ['{RULES[-1][1]}'] ELSE kinds END kinds FROM steps JOIN listed USING (doc_id) WHERE k = {len(RULES) - 1})
SELECT d.doc_id, coalesce(n_known, 0) n_known, coalesce(sentence_ids, '') sentence_ids, coalesce(array_to_string(list_sort(list_distinct(names)), ','), '') licenses, CASE {case} ELSE 'none' END AS category
FROM documents d LEFT JOIN listed USING (doc_id) LEFT JOIN judged USING (doc_id)
"""


SQL = _sql()
