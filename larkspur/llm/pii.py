r"""Personal data: regular expressions propose, checksums confirm, nearby words adjust the score.

Every kind has a pattern (leftmost, non-overlapping matches), a validator of the match and a starting score; words near
the match add to the score. A span of a base kind (email, ip, card, phone) counts once its validator holds. The other
kinds count from a score of ``KEEP``: an IBAN whose mod-97 check holds gets there alone, a social security number, which
has no checksum, only beside words that say so.

Positions come from the lengths of what lies between matches, so each text is read once for each kind and no row leaves
its task. The patterns are possessive and none begins inside of a run that it has failed on, so a text of any length is read
in time linear in it, without overflowing the stack.

Defined cases: a null or empty text has no spans; positions are code points, the end exclusive; very long texts, and runs of
a megabyte of digits in them, are read whole; repeated rows are answered alike; other columns are dropped, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import let

KEEP = 0.5
AROUND = 40
_BLOCK = 512


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check: from the right every second digit counts double, less 9 if above 9."""

    def value(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + value(i))
    return F.when(F.length(digits) > 0, total % 10 == 0).otherwise(F.lit(False))


def mod97(iban: Column) -> Column:
    """Whether an IBAN's remainder is 1: first four characters last, letters as 10 to 35."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))

    def step(s: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (s * 100 + code - 55) % 97).otherwise((s * 10 + code - 48) % 97)

    return F.aggregate(F.array_remove(F.split(turned, ""), ""), F.lit(0), step) == 1


def _small_parts(ip: Column) -> Column:
    """No part above 255, leading zeros aside."""
    parts = F.transform(F.split(ip, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A cheap sign without which a text has no match.
    sign: str
    score: float
    context: str
    base: bool = True
    #: A short pattern without which a text has no valid match either: most texts are looked through for it alone.
    look: str = ""

    def valid(self, m: Column) -> Column:
        if self.name == "ip":
            return _small_parts(m)
        if self.name == "card":
            return let(_digits(m), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False)))
        if self.name == "phone":
            return F.length(_digits(m)).between(10, 15)
        if self.name == "iban":
            return let(F.regexp_replace(m, " ", ""), lambda b: F.when(F.length(b).between(15, 34), mod97(b)).otherwise(F.lit(False)))
        return F.lit(True)


#: Countries by the length of their IBANs, so that a word after one isn't taken for a part of it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FO|FI|GL|NL|SD|FK", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|XK|MN", 21: "HR|LI|LV|CH", 22: "BH|BG|CR|GE|DE|IE|ME|RS|GB|VA", 23: "GI|IQ|IL|TL|AE|OM|SO",
    24: "AD|CZ|MD|PK|RO|SA|SK|ES|SE|TN|VG", 25: "PT|ST|LY", 26: "IS|TR", 27: "FR|GR|IT|MC|SM|BI|DJ", 28: "AL|AZ|CY|DO|GT|HU|LB|PL|BY|SV|NI", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join([*(f"(?:{countries})[0-9]{{2}}(?: ?[A-Z0-9]){{{size - 4}}}" for size, countries in IBAN_LENGTHS.items()), "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}"])

#: In the order in which spans of one start are listed.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, r"mail|contact|write|kontakt|correo|courriel|schreib"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, r"\bip\b|host|server|address|adresse|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", 0.6, r"card|visa|master|amex|payment|karte|carte|tarjeta", look=r"[0-9](?:[\x20-]?[0-9]){13}"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, r"phone|\btel|call|mobil|fax|anruf|appel|llam"),
    Kind("iban", rf"(?<![A-Za-z0-9])(?:{_IBAN})(?![A-Za-z0-9])", "", 0.6, r"iban|account|bank|konto|compte|cuenta", False, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2} ?[A-Z0-9] ?[A-Z0-9]"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3, r"\bssn\b|social security", False),
)


def _scan(parts: Column) -> Column:
    """Spans from (gap, size, text, near) parts in order; blocks keep the running sums linear."""
    empty = F.array().cast("array<struct<start:int,end:int,text:string,near:string>>")

    def blocks(b: Column) -> Column:
        return F.slice(parts, b * _BLOCK + 1, F.lit(_BLOCK))

    def total(p: Column) -> Column:
        return F.aggregate(p, F.lit(0), lambda s, x: s + x["gap"] + x["size"])

    def one(p: Column, start: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            at = s["at"] + x["gap"]
            return F.struct((at + x["size"]).alias("at"), F.concat(s["out"], F.array(F.struct(at.alias("start"), (at + x["size"]).alias("end"), x["text"].alias("text"), x["near"].alias("near")))).alias("out"))

        return F.aggregate(p, F.struct(start.alias("at"), empty.alias("out")), step, lambda s: s["out"])

    numbers = F.sequence(F.lit(0), F.ceil(F.size(parts) / _BLOCK).cast("int") - 1)
    sums = F.transform(numbers, lambda b: total(blocks(b)))
    return let(sums, lambda t: F.flatten(F.transform(numbers, lambda b: one(blocks(b), F.aggregate(F.slice(t, F.lit(1), b), F.lit(0), lambda s, x: s + x)))))


def matches(text: Column, kind: Kind) -> Column:
    """The matches of a kind's pattern that its validator confirms: array of (start, end, text, near)."""

    def parts(found: Column, gaps: Column) -> Column:
        near = lambda i: F.lower(F.concat(F.right(F.get(gaps, i), F.lit(AROUND)), F.lit(" "), F.left(F.get(gaps, i + 1), F.lit(AROUND))))
        return F.transform(found, lambda m, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("size"), m.alias("text"), near(i).alias("near")))

    none = F.array().cast("array<struct<start:int,end:int,text:string,near:string>>")
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    spans = let(found, lambda f: F.when(F.size(f) > 0, let(F.split(text, kind.pattern, -1), lambda g: let(parts(f, g), _scan))).otherwise(none))
    has = F.contains(text, F.lit(kind.sign)) if kind.sign else F.lit(True)
    some = F.when(has & text.rlike(kind.look) if kind.look else has, spans).otherwise(none)
    return F.filter(some, lambda s: kind.valid(s["text"]))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, spans: array of (start, rank, kind, end, text, score) by start, then kind as listed."""

    def scored(kind: Kind, rank: int) -> Column:
        def one(s: Column) -> Column:
            score = F.lit(kind.score) + F.when(s["near"].rlike(kind.context), F.lit(0.2 if kind.base else 0.3)).otherwise(F.lit(0.0))
            return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), s["end"].alias("end"), s["text"].alias("text"), F.round(score, 3).alias("score"))

        spans = F.transform(F.col(f"__{kind.name}"), one)
        return spans if kind.base else F.filter(spans, lambda s: s["score"] >= KEEP)

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__t"))
    each = texts.select("doc_id", *[matches(F.col("__t"), k).alias(f"__{k.name}") for k in KINDS])
    return each.select("doc_id", F.array_sort(F.concat(*[scored(k, i) for i, k in enumerate(KINDS)])).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as a string."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = [k.name for k in KINDS if k.base]

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in base]
    return found.select("doc_id", *counts, F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.array_max(F.transform("spans", lambda s: s["score"])).alias("top_score"))


#: The base kinds' columns over small tables in DuckDB: spans from what lies between matches, validated by list functions.
BASE_SQL = r"""
WITH kinds(kind, rank) AS (VALUES ('email', 0), ('ip', 1), ('card', 2), ('phone', 3)),
texts AS (SELECT doc_id, coalesce(text, '') t FROM documents),
found AS (SELECT doc_id, kind, rank, t, CASE kind WHEN 'email' THEN regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') WHEN 'ip' THEN regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') WHEN 'card' THEN regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+') ELSE regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]') END ms FROM texts, kinds),
gaps AS (SELECT doc_id, kind, rank, ms, CASE kind WHEN 'email' THEN regexp_split_to_array(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') WHEN 'ip' THEN regexp_split_to_array(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') WHEN 'card' THEN regexp_split_to_array(t, '[0-9]([\x20-]?[0-9])+') ELSE regexp_split_to_array(t, '\+[0-9][\x20().0-9-]+[0-9]') END gs FROM found WHERE len(ms) > 0),
each AS (SELECT doc_id, kind, rank, unnest(ms) m, unnest(gs[1:len(ms)]) g, generate_subscripts(ms, 1) i FROM gaps),
placed AS (SELECT doc_id, kind, rank, m, sum(length(g) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) e FROM each),
digits AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') d FROM placed),
valid AS (SELECT doc_id, kind, rank, CAST(e - length(m) AS BIGINT) s, CAST(e AS BIGINT) e FROM digits WHERE CASE kind WHEN 'email' THEN true
 WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR (length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0
 WHEN 'card' THEN length(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(0, length(d)), lambda k: CASE WHEN k % 2 = 0 THEN CAST(d[length(d) - k] AS INTEGER) ELSE CAST(d[length(d) - k] AS INTEGER) * 2 // 10 + CAST(d[length(d) - k] AS INTEGER) * 2 % 10 END)) % 10 = 0
 ELSE length(d) BETWEEN 10 AND 15 END)
SELECT t.doc_id, count(*) FILTER (WHERE kind = 'email') n_email, count(*) FILTER (WHERE kind = 'ip') n_ip, count(*) FILTER (WHERE kind = 'card') n_card, count(*) FILTER (WHERE kind = 'phone') n_phone,
 sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (WHERE kind IS NOT NULL), '')) base_sha256 FROM texts t LEFT JOIN valid v USING (doc_id) GROUP BY t.doc_id
"""
