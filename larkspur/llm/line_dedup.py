r"""Cross-site boilerplate removal: lines that stand on many distinct sites go.

Each distinct line is a pair of hashes. Its sites are counted by a HyperLogLog sketch, which map-side aggregation keeps to
one small sketch a line and task, however hot the line; lines whose estimate is near the threshold get an exact distinct
count. A line is boilerplate from ``min_sites`` sites. Documents lose their boilerplate lines, even if nothing is left, but
for one case: a document of whose distinct lines those are more than ``most_removed`` of the characters and that is a
proven copy of another such document keeps its whole text, because that is a copy, not a page with boilerplate around it,
and removing copies is the near-duplicate join's work.

A copy is proven by an equal text, or by a text of exactly computed similarity 0.8 or more (five-word shingles). First,
texts meet in buckets of two minima of their shingles' hashes, ``BUCKETS`` of them a text; each bucket has one member that
the others are compared with, another one in every bucket: that proves nearly all members of large groups, and each costs
a few comparisons. What isn't proven then is joined with all such texts by prefix: shingles in order of rarity, two texts
of similarity 0.8 share one among each one's first fifth, and what follows the first that they share bounds how many more.
So no copy is missed, however alike the crowd around it is.

Defined cases: a null text is an empty one (one empty line); lines are what stands between line feeds, compared byte by
byte; lines of white space only are never boilerplate; a null site counts for no line; repeated rows are treated alike (and
are copies of each other); texts of any length are read whole; an empty table has no boilerplate; own columns
that clash with the result's four are replaced, others are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import NEAR, discard, let, shingle_hashes, words, written

MIN_SITES = 8
MOST_REMOVED = 0.5
LG_K = 10
#: Three standard errors of a sketch of 2 ** LG_K registers.
BAND = 3 * 1.04 / 2 ** (LG_K / 2)
MAX_BROADCAST_LINES = 200_000
BUCKETS = 8


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _keys(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("k1"), F.crc32(line).alias("k2")]


def _counted_lines(text: Column) -> Column:
    return F.filter(F.array_distinct(_lines(text)), lambda line: F.trim(F.translate(line, "\t\r\f\u000b", "    ")) != "")


def boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """k1, k2, sites: the lines on at least ``min_sites`` distinct sites."""
    on = docs.select(F.col(site).cast("string").alias("site"), F.explode(_counted_lines(F.col("text"))).alias("line")).select("site", *_keys(F.col("line"))).filter(F.col("site").isNotNull())
    spread = on.groupBy("k1", "k2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("about"))
    low, high = min(min_sites - 1, int(min_sites * (1 - BAND))), max(min_sites + 1, int(min_sites * (1 + BAND)) + 1)
    likely = written(spread.filter(F.col("about") >= low), "lines")
    close = likely.filter(F.col("about") <= high).select("k1", "k2")
    exact = on.join(close, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.countDistinct("site").alias("sites")).filter(F.col("sites") >= min_sites)
    sure = likely.filter(F.col("about") > high).select("k1", "k2", F.col("about").alias("sites"))
    return sure.unionByName(exact)


def _each_text(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """text_key, shingles of one document (__doc, text_key) of each wanted text."""
    rows = docs.select("doc_id", "text", _text_key(F.col("text")).alias("__key"))
    few = wanted.count() <= MAX_BROADCAST_LINES
    found = rows.join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__key") == F.col("text_key")))
    return found.select("text_key", F.array_distinct(shingle_hashes(words(F.col("text")))).alias("shingles")).dropDuplicates(["text_key"])


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def copies(docs: DataFrame, some: DataFrame, near: float = NEAR) -> DataFrame:
    """text_key of those of ``some`` (doc_id, text_key, times: rows of ``docs``) whose text another row of ``some`` equals or resembles.

    Exact: what buckets don't prove is looked for by _prefix_pairs().
    """
    texts = written(some.groupBy("text_key").agg(F.sum("times").alias("times"), F.min(F.struct("doc_id"))["doc_id"].alias("__doc")), "texts")
    each = written(_each_text(docs, texts.select("__doc", "text_key")).filter(F.size("shingles") > 0), "shingles")

    def minimum(i: int) -> Column:
        return F.array_min(F.transform("shingles", lambda h: F.xxhash64(h, F.lit(i))))

    keys = F.array(*[F.xxhash64(F.lit(i), minimum(2 * i), minimum(2 * i + 1)) for i in range(BUCKETS)])
    buckets = written(each.select("text_key", F.explode(keys).alias("bucket")), "buckets")
    first = F.min(F.struct(F.xxhash64("text_key", "bucket"), "text_key"))["text_key"]
    # a table of its own, so that Spark can split the rows of a large bucket in the join
    firsts = written(buckets.groupBy("bucket").agg(F.count("*").alias("n"), first.alias("first")).filter("n > 1").drop("n"), "firsts")
    pairs = buckets.join(firsts, "bucket").filter("text_key <> first").select("text_key", F.col("first").alias("other")).distinct()
    proven = written(_alike(pairs, each, near).unionByName(texts.filter("times > 1").select("text_key")).distinct(), "proven")
    unproven = written(each.join(proven, "text_key", "left_anti"), "unproven")
    more = _alike(_prefix_pairs(unproven, each, near), each, near)
    out = written(proven.unionByName(more).distinct(), "copies")
    discard(texts, each, buckets, firsts, proven, unproven)
    return out


def _alike(pairs: DataFrame, each: DataFrame, near: float) -> DataFrame:
    """text_key of both sides of the pairs (text_key, other) that are as similar as ``near``."""
    met = pairs.join(each.select(F.col("text_key").alias("other"), F.col("shingles").alias("theirs")), "other").join(each, "text_key")
    both = F.size(F.array_intersect("shingles", "theirs"))
    like = met.filter(both >= near * (F.size("shingles") + F.size("theirs") - both) - 1e-6)
    return like.select(F.explode(F.array("text_key", "other")).alias("text_key"))


def _prefix_pairs(asked: DataFrame, each: DataFrame, near: float) -> DataFrame:
    """text_key of ``asked``, other: all pairs with a text of ``each`` (text_key, shingles) that may be as similar as ``near``."""
    rows = each.select("text_key", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    rarity = rows.groupBy("shingle").agg(F.count("*").alias("df"))
    in_order = rows.join(rarity, "shingle").groupBy("text_key").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("s"))
    # more of the text than this can't be missing from a text that is as similar
    first = F.slice("s", F.lit(1), F.least(F.size("s"), F.floor((1 - near) * F.col("n") + 1e-6).cast("int") + 1))
    prefixes = written(in_order.select("text_key", "n", F.posexplode(first).alias("at", "x")).filter("x.df > 1").select("text_key", "n", "at", F.col("x.shingle").alias("shingle")), "prefixes")
    theirs = prefixes.select(F.col("text_key").alias("other"), F.col("n").alias("n2"), F.col("at").alias("at2"), "shingle")
    # no more than what follows, since each pair meets at the first shingle that it shares too: nothing before is shared there
    shared = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2"))
    may = (F.col("text_key") != F.col("other")) & (F.col("n2") >= near * F.col("n") - 1e-6) & (F.col("n") >= near * F.col("n2") - 1e-6) & (shared >= near / (1 + near) * (F.col("n") + F.col("n2")) - 1e-6)
    return prefixes.join(asked.select("text_key"), "text_key", "left_semi").join(theirs, "shingle").filter(may).select("text_key", "other").distinct()


def dedup_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, most_removed: float = MOST_REMOVED) -> DataFrame:
    """The documents with n_lines, n_boilerplate (lines), whole_copy (kept for that reason) and n_removed; text is what stays.

    Own columns of those names are replaced.
    """
    spread = written(boilerplate(docs, site, min_sites).select("k1", "k2"), "boilerplate")
    few = spread.count() <= MAX_BROADCAST_LINES
    # bound once, so that the lines are made once for their total and themselves
    listed = let(_counted_lines(F.col("text")), lambda x: F.struct(F.length(F.array_join(x, "")).alias("total"), x.alias("lines")))
    listed = docs.select("doc_id", _text_key(F.col("text")).alias("text_key"), F.inline(F.array(listed)).alias("__total", "__lines"))
    own = listed.select("doc_id", "text_key", "__total", F.explode("__lines").alias("line")).select("doc_id", "text_key", "__total", F.length("line").alias("n"), *_keys(F.col("line")))
    hits = own.join(F.broadcast(spread) if few else spread, ["k1", "k2"]).groupBy("doc_id", "text_key")
    hits = hits.agg(F.collect_set(F.struct("k1", "n")).alias("__hit"), F.max("__total").alias("__total"), F.count("*").alias("__rows"))
    share = F.aggregate("__hit", F.lit(0), lambda s, x: s + x["n"]) / F.col("__total")
    # a row that is repeated hits each line as often
    times = (F.col("__rows") / F.size("__hit")).cast("long")
    hits = hits.select("doc_id", "text_key", F.transform("__hit", lambda x: x["k1"]).alias("__bad"), (share > most_removed).alias("__heavy"), times.alias("times"))
    hits = written(hits, "hits")
    spared = copies(docs, hits.filter("__heavy").select("doc_id", "text_key", "times"))
    marked = hits.join(spared.withColumn("__copy", F.lit(True)), "text_key", "left").select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__text"), "__bad", "__copy")
    named = docs.drop("n_lines", "n_boilerplate", "whole_copy", "n_removed")
    joined = named.join(marked, named["doc_id"].eqNullSafe(marked["__doc"]) & (_text_key(named["text"]) == marked["__text"]), "left")
    known = joined.withColumn("__lines", _lines(F.col("text"))).withColumn("__copy", F.coalesce("__copy", F.lit(False)))
    known = known.withColumn("__kept", F.when(F.col("__bad").isNull(), F.col("__lines")).otherwise(F.filter("__lines", lambda line: ~F.array_contains(F.col("__bad"), F.xxhash64(line)))))
    out = F.when(F.col("__copy") | F.col("__bad").isNull(), F.col("text")).otherwise(F.array_join("__kept", "\n"))
    extra = {
        "n_lines": F.size("__lines").cast("long"),
        "n_boilerplate": (F.size("__lines") - F.size("__kept")).cast("long"),
        "whole_copy": F.col("__copy"),
        "n_removed": F.when(F.col("__copy"), F.lit(0)).otherwise(F.size("__lines") - F.size("__kept")).cast("long"),
    }
    return known.withColumns(extra | {"text": out}).select(*named.columns, *extra)


def digest(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "n_lines", "n_boilerplate", "whole_copy", "n_removed", F.coalesce("text", F.lit("")).alias("text"))


SQL = rf"""
WITH lines AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) i FROM documents),
spread AS (SELECT line FROM lines WHERE trim(line, chr(32) || chr(9) || chr(13) || chr(12) || chr(11)) <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (SELECT l.*, s.line IS NOT NULL bad FROM lines l LEFT JOIN spread s ON l.line = s.line),
share AS (SELECT doc_id, coalesce(sum(length(line)) FILTER (WHERE bad), 0) > {MOST_REMOVED} * sum(length(line)) heavy FROM (SELECT DISTINCT doc_id, line, bad FROM marked WHERE trim(line, chr(32) || chr(9) || chr(13) || chr(12) || chr(11)) <> '') GROUP BY doc_id),
heavy AS (SELECT d.doc_id, d.text, list_filter(regexp_split_to_array(translate(d.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') ws FROM documents d JOIN share s ON s.doc_id = d.doc_id WHERE heavy),
texts AS (SELECT text, count(*) times, any_value(CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] END) s FROM heavy GROUP BY text),
tokens AS (SELECT text, len(s) n, unnest(s) t FROM texts),
copies AS (SELECT text FROM texts WHERE times > 1 UNION SELECT a.text FROM tokens a JOIN tokens b ON a.t = b.t AND a.text <> b.text GROUP BY a.text, b.text, a.n, b.n HAVING count(*) >= {NEAR} * (a.n + b.n - count(*)) - 1e-6),
spared AS (SELECT DISTINCT h.doc_id FROM heavy h JOIN copies c ON c.text = h.text),
judged AS (SELECT doc_id, count(*) n_lines, count(*) FILTER (WHERE bad) n_boilerplate, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT bad), '') rest, string_agg(line, chr(10) ORDER BY i) whole FROM marked GROUP BY doc_id)
SELECT j.doc_id, n_lines, n_boilerplate, s.doc_id IS NOT NULL AS whole_copy, CASE WHEN s.doc_id IS NOT NULL THEN 0 ELSE n_boilerplate END n_removed, CASE WHEN s.doc_id IS NOT NULL THEN whole ELSE rest END AS text FROM judged j LEFT JOIN spared s ON s.doc_id = j.doc_id
"""
