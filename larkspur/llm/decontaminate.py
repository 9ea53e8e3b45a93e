"""Benchmark decontamination: where texts repeat windows of benchmark items, exactly.

A prefix-filtered set join. A window is 13 consecutive words of an item (a shorter item is one window), and containment
of a whole window is wanted, so the prefix that a match can't avoid is a single word: the window's rarest in the corpus.
Windows of an item that share their rarest word share one anchor. Words of the documents are joined with the anchors
(equality on the word), length and positional bounds drop what can't hold a window there, the next rarest word that all
windows of the anchor share must stand at its distance, and what is left is verified word by word around the anchor.

Everything is column expressions and joins. Anchors are broadcast in blocks of at most ``MAX_ANCHORS``, each of at most
25 words, so what a broadcast holds is bounded; a larger benchmark takes more passes over the documents.

Defined cases: null and empty texts and items have no words; items without words match nothing; repeated rows get as many
equal answers; texts and items of any length are read whole, a window never carries more than the 25 words around it; an
empty benchmark hits nothing, an empty table gives no rows. Verdicts have columns of their own only, whatever the documents'
are called; ``clean`` returns the documents' columns as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import words, written

WINDOW = 13
MAX_ANCHORS = 100_000


def rarity(docs: DataFrame, item_words: DataFrame) -> DataFrame:
    """(word, n): how often each word of the benchmark stands in all documents, 0 included."""
    wanted = written(item_words.select("word").distinct(), "vocabulary")
    seen = docs.select(F.explode(words(F.col("text"))).alias("word"))
    if wanted.count() <= MAX_ANCHORS:
        found = seen.join(F.broadcast(wanted), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    else:
        found = seen.groupBy("word").agg(F.count("*").alias("n")).join(wanted, "word", "left_semi")
    return wanted.join(found, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def anchors(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rarest word of each window, once for all neighbouring windows that share it.

    word, item_id, before (words of the part before the anchor), part (the words that the anchor's windows cover),
    least (words that a match needs), gap and also (distance and text of another word that all its windows share).
    """
    listed = items.select("item_id", words(F.col("text")).alias("ws")).filter(F.size("ws") > 0).distinct().withColumn("item", F.xxhash64("item_id", F.concat_ws(" ", "ws")))
    each = listed.select("item_id", "item", F.least(F.lit(window), F.size("ws")).alias("least"), F.size("ws").alias("size"), F.posexplode("ws").alias("at", "word"))
    ranked = each.join(rarity(docs, each), "word").withColumn("rank", F.struct("n", "word", "at"))
    # an item is its hash from here on: its id may be null
    in_order = Window.partitionBy("item").orderBy("at")
    ahead, around = in_order.rowsBetween(0, window - 1), in_order.rowsBetween(1 - window, window - 1)
    near = ranked.select("item_id", "item", "least", "size", "at", F.min("rank").over(ahead)["at"].alias("rarest"), F.collect_list(F.struct("at", "rank")).over(around).alias("around"))
    runs = near.filter(F.col("at") <= F.col("size") - F.col("least")).groupBy("item", "rarest").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    found = runs.withColumnRenamed("rarest", "at").join(near.select("item_id", "item", "least", "at", "around"), ["item", "at"])
    part = F.transform(F.filter("around", lambda r: r["at"].between(F.col("lo"), F.col("hi") + F.col("least") - 1)), lambda r: r["rank"]["word"])
    # all its windows cover the words from hi to lo + least - 1
    shared = F.transform(F.filter("around", lambda r: r["at"].between(F.col("hi"), F.col("lo") + F.col("least") - 1) & (r["at"] != F.col("at"))), lambda r: r["rank"])
    return found.select("item_id", "least", (F.col("at") - F.col("lo")).alias("before"), part.alias("part"), F.array_min(shared).alias("second"), "at").select(
        F.expr("part[before]").alias("word"), "item_id", "before", "part", "least", (F.col("second.at") - F.col("at")).alias("gap"), F.col("second.word").alias("also")
    )


def _equal_run(ws: Column, at: Column) -> tuple[Column, Column]:
    """How many words before and after the anchor equal the item's without a break."""
    same = F.array_join(F.transform(F.col("part"), lambda w, i: F.when(F.coalesce(F.get(ws, at - F.col("before") + i) == w, F.lit(False)), "1").otherwise("0")), "")
    left = F.length(F.regexp_extract(F.substr(same, F.lit(1), F.col("before")), "1*$", 0))
    right = F.length(F.regexp_extract(F.substr(same, F.col("before") + 2), "^1*", 0))
    return left, right


def _matches(texts: DataFrame, block: DataFrame) -> DataFrame:
    """key, n_words, lead and, where an anchor's windows occur, lo and hi (positions of hit words) and item_id; a lead row without hit for each text."""
    # "" is no word: it leads every text and has an anchor of its own, so that the join keeps one row of each text
    led = texts.select("doc_id", "__text", F.size("ws").alias("n_words"), "ws", F.posexplode(F.concat(F.array(F.lit("")), F.col("ws"))).alias("at1", "word"))
    first = block.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(0).alias("least"))
    at = F.col("at1") - 1
    fits = (at + F.size("part") - F.col("before") >= F.col("least")) & (F.col("n_words") >= F.col("least"))
    next_one = F.col("gap").isNull() | F.coalesce(F.get(F.col("ws"), F.when(at + F.col("gap") >= 0, at + F.col("gap"))) == F.col("also"), F.lit(False))
    near = led.join(F.broadcast(block.unionByName(first, allowMissingColumns=True).withColumnRenamed("word", "__anchor")), (F.col("word") == F.col("__anchor")) & ((F.col("at1") == 0) | (fits & next_one)))
    left, right = _equal_run(F.col("ws"), at)
    # no filter on what is verified: Spark would move it into the join, which then could not be compiled
    sized = near.withColumn("__run", F.when(F.col("at1") > 0, F.struct(left.alias("left"), right.alias("right"))))
    hit = F.col("__run.left") + F.col("__run.right") + 1 >= F.col("least")
    return sized.select("doc_id", "__text", "n_words", (F.col("at1") == 0).alias("lead"), F.when(hit, F.struct((at - F.col("__run.left")).alias("lo"), (at + F.col("__run.right")).alias("hi"))).alias("run"), F.when(hit, F.col("item_id")).alias("item_id"))


def covered(runs: Column) -> Column:
    """How many positions the ascending [lo, hi] runs cover together."""
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end"))
    return F.aggregate(
        runs,
        state,
        lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["hi"] - F.greatest(s["end"] + 1, r["lo"]) + 1)).cast("long").alias("n"), F.greatest(s["end"], r["hi"]).alias("end")),
        lambda s: s["n"],
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_anchors: int = MAX_ANCHORS) -> DataFrame:
    """doc_id, text_key, n_words, runs (array of lo, hi word positions), item_ids (sorted array), one row for each of ``docs``."""
    marks = written(anchors(docs, items, window), "anchors")
    n = marks.count()
    blocks = max(1, -(-n // max_anchors))
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("__text"), words(F.col("text")).alias("ws"))
    parts = [_matches(texts, marks if blocks == 1 else marks.filter(F.pmod(F.xxhash64("word"), F.lit(blocks)) == b)) for b in range(blocks)]
    found = reduce(DataFrame.unionByName, parts)
    answers = found.groupBy("doc_id", F.col("__text").alias("text_key")).agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_set("run")).alias("runs"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"),
        (F.sum(F.col("lead").cast("int")) / blocks).cast("int").alias("times"),
    )
    # rows that repeat a doc_id and its text were answered together
    return answers.withColumn("__each", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "__each")


def verdicts(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """contamination() with n_hit, n_items and contaminated: at least one word hit, and a twentieth of all words."""
    found = contamination(docs, items, window).withColumn("n_hit", covered(F.col("runs"))).withColumn("n_items", F.size("item_ids").cast("long"))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    bad = verdicts(docs, items, window).filter("contaminated").select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__doc"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["__key"]), "left_anti")


#: Words of a text in DuckDB, as an array, and the windows of the items.
SQL = r"""
WITH items AS (SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') ws FROM benchmark),
docs AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') ws FROM documents),
spans AS (SELECT item_id, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') span, least(13, len(ws)) n FROM items, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) t(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM spans),
found AS (SELECT DISTINCT d.doc_id, i AS pos, s.n, s.item_id FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) i FROM docs, sizes WHERE len(ws) >= n) d JOIN spans s ON s.n = d.n AND s.span = array_to_string(d.ws[d.i:d.i + d.n - 1], ' ')),
hits AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) p FROM found) GROUP BY 1),
named AS (SELECT doc_id, count(*) n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) names FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
       sha256(coalesce(names, '')) items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated
FROM docs d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def digest(found: DataFrame) -> DataFrame:
    """The columns of verdicts() with the item ids as a hash."""
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")
