"""Queries of the text functions and of the formats that are text."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import text as t
from larkspur.functions.chunking import ChunkOptions, chunk_documents
from larkspur.operators import bm25
from larkspur.plans import corpus
from larkspur.plans.tables import spread, table

#: One paragraph a line, as the driver's documents have no blank lines.
CHUNKS = ChunkOptions(max_tokens=128, overlap=20, separator="\n")

NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\p{P}\p{S}\p{Z}\x{80}-\x{9F}]+"
TOKENS = rf"list_filter(regexp_split_to_array(translate(text, '{t.UPPER}', '{t.LOWER}'), '{NOT_WORD}'), lambda x: x <> '')"
CLEAN = r"trim(regexp_replace({}, '[\t\n\f\r ]+', ' ', 'g'))"


def _docs(expression):
    return lambda spark, sf: spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", *expression())


def _pages(expression):
    return lambda spark, sf: spread(table(spark, sf, "pages").select("page_id", "html")).select("page_id", *expression())


def _csv_lines():
    return F.concat_ws(",", F.concat(F.lit('"'), "event_type", F.lit('"')), F.col("user_id").cast("string"), F.lit(" "), F.concat(F.lit(' "'), F.col("event_id").cast("string"), F.lit('"')))


def _rtf():
    return F.concat(F.lit(r"{\rtf1\ansi \b "), "event_type", F.lit(r"\b0\par user "), F.col("user_id").cast("string"), F.lit("}"))


#: Signs that stand for digits, so that numbers become runs of Chinese and Japanese signs.
SIGNS = "日月火水木金土かナ한"


def _mixed():
    """A word, a run of signs within a word, full-width punctuation, and a run alone."""
    signs = F.translate(F.col("event_id").cast("string"), "0123456789", SIGNS)
    return F.concat("event_type", signs, F.lit("x，"), signs, F.lit("。"))


QUERIES = {
    "clean_text": _docs(lambda: [t.clean_text(F.col("text")).alias("text")]),
    "token_estimate": _docs(lambda: [t.estimated_tokens(F.col("text")).alias("tokens")]),
    "ascii_lower": _docs(lambda: [t.ascii_lower(F.col("text")).alias("text")]),
    "html_strip": _pages(lambda: [t.html_text(F.col("html")).alias("text")]),
    "html_title": _pages(lambda: [t.title_of(F.col("html")).alias("title")]),
    "json_strings": lambda spark, sf: table(spark, sf, "events").select("event_id", t.json_strings(F.col("props")).alias("text")),
    "csv_fields": lambda spark, sf: table(spark, sf, "events").select("event_id", t.csv_values(_csv_lines()).alias("text")),
    "yaml_values": lambda spark, sf: table(spark, sf, "events").select("event_id", t.yaml_values(F.concat(F.lit("# made\ntype: "), "event_type", F.lit("\n- user: "), F.col("user_id").cast("string"), F.lit("\nprops: "), "props", F.lit("\n- item\n"))).alias("text")),
    "rtf_strip": lambda spark, sf: table(spark, sf, "events").select("event_id", t.rtf_text(_rtf()).alias("text")),
    "tokenize": _docs(lambda: [F.array_join(t.tokenize(F.col("text")), " ").alias("tokens")]),
    "tokenize_cjk": lambda spark, sf: table(spark, sf, "events").select("event_id", F.array_join(t.tokenize(_mixed()), " ").alias("tokens")),
    "term_freq": lambda spark, sf: bm25.term_frequencies(corpus.texts(spark, sf)),
    "doc_freq": lambda spark, sf: bm25.document_frequencies(bm25.term_frequencies(corpus.texts(spark, sf))),
    "avg_doc_len": lambda spark, sf: bm25.corpus_statistics(corpus.texts(spark, sf)).select("n", F.round("avgdl", 6).alias("avgdl")),
    "paragraphs": lambda spark, sf: table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("text")).select("conv_id", F.posexplode(t.index_paragraphs(F.col("text"), 200)).alias("n", "paragraph")).withColumn("n", F.col("n").cast("long")),
    "unfenced": lambda spark, sf: table(spark, sf, "events").select("event_id", t.unfenced(F.concat(F.when(F.col("event_id") % 2 == 0, " ```json\n").otherwise("```"), "props", F.lit("\n``` "))).alias("answer")),
    "escaped_like": lambda spark, sf: table(spark, sf, "events").select("event_id", t.escape_like(F.concat("event_type", F.lit("_50%\\"), "props")).alias("pattern")),
    "sentences": _docs(lambda: [F.posexplode(t.sentences(F.col("text"))).alias("n", "sentence")]),
    "hier_sentences": _docs(lambda: [F.posexplode(t.index_sentences(F.col("text"))).alias("n", "sentence")]),
    "chunk_documents": lambda spark, sf: chunk_documents(spread(table(spark, sf, "documents").select("doc_id", "text")), CHUNKS, "doc_id").select(F.col("document_id").alias("doc_id"), F.col("chunk_index").cast("long").alias("chunk_index"), "text"),
}

_PIECES = "unnest(generate_series(1, greatest(length(p), 1), 200))"

EDGES = r"regexp_replace({}, '^[\s\x0B\x{{85}}\p{{Z}}]+|[\s\x0B\x{{85}}\p{{Z}}]+$', '', 'g')"
#: The fold over paragraphs as recursion, and over the sentences, then the words of what is longer than a chunk may be (8192 tokens).
CHUNKS_SQL = rf"""WITH RECURSIVE lines AS (SELECT doc_id, {EDGES.format("unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)))")} p, unnest(range(len(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))))) i FROM documents WHERE text IS NOT NULL),
 parts AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY i) i FROM lines WHERE p <> ''),
 fold AS (SELECT doc_id, i, p b, NULL::VARCHAR done FROM parts WHERE i = 1
  UNION ALL SELECT doc_id, i, CASE WHEN NOT filled THEN b || chr(10) || chr(10) || p WHEN len(ws) <= 20 THEN {EDGES.format("b")} || chr(10) || chr(10) || p ELSE array_to_string(ws[-20:], ' ') || chr(10) || chr(10) || p END, CASE WHEN filled THEN b END
  FROM (SELECT f.doc_id, q.i, f.b, q.p, octet_length(encode(f.b || chr(10) || chr(10) || q.p)) >= 4 * 129 AS filled, list_filter(regexp_split_to_array(f.b, '[\s\x0B\x{{85}}\p{{Z}}]+'), lambda x: x <> '') ws FROM fold f JOIN parts q ON q.doc_id = f.doc_id AND q.i = f.i + 1)),
 buffers AS (SELECT doc_id, 2 * i o, {EDGES.format("done")} b FROM fold WHERE done IS NOT NULL UNION ALL SELECT doc_id, 2 * max(i) + 1, {EDGES.format("arg_max(b, i)")} FROM fold GROUP BY doc_id),
 long AS (SELECT doc_id, o, list_filter(list_transform(regexp_extract_all(replace(b, chr(10), ' '), '[^.?!]*[.?!]|[^.?!]+$'), lambda x: trim(x)), lambda x: x <> '') ss FROM buffers WHERE octet_length(encode(b)) >= 4 * 8193),
 told AS (SELECT doc_id, o, unnest(ss) s, generate_subscripts(ss, 1) i FROM long),
 packed AS (SELECT doc_id, o, i, s b, NULL::VARCHAR done FROM told WHERE i = 1
  UNION ALL SELECT f.doc_id, f.o, t.i, CASE WHEN octet_length(encode(b || ' ' || s)) >= 4 * 8193 THEN s ELSE b || ' ' || s END, CASE WHEN octet_length(encode(b || ' ' || s)) >= 4 * 8193 THEN b END FROM packed f JOIN told t ON t.doc_id = f.doc_id AND t.o = f.o AND t.i = f.i + 1),
 told_pieces AS (SELECT doc_id, o, 2 * i j, done b FROM packed WHERE done IS NOT NULL UNION ALL SELECT doc_id, o, 2 * max(i) + 1, arg_max(b, i) FROM packed GROUP BY doc_id, o),
 words AS (SELECT doc_id, o, j, w, i, sum(octet_length(encode(w)) + 1) OVER (PARTITION BY doc_id, o, j ORDER BY i) c FROM (SELECT doc_id, o, j, unnest(ws) w, generate_subscripts(ws, 1) i FROM (SELECT doc_id, o, j, list_filter(regexp_split_to_array(b, '[\s\x0B\x{{85}}\p{{Z}}]+'), lambda x: x <> '') ws FROM told_pieces WHERE octet_length(encode(b)) >= 4 * 8193))),
 reach AS (SELECT a.doc_id, a.o, a.j, a.i, max(z.i) hi FROM words a JOIN words z ON z.doc_id = a.doc_id AND z.o = a.o AND z.j = a.j AND z.i >= a.i AND (z.i = a.i OR z.c - 1 - (a.c - octet_length(encode(a.w)) - 1) < 4 * 8193) GROUP BY a.doc_id, a.o, a.j, a.i),
 jumps AS (SELECT doc_id, o, j, i, hi FROM reach WHERE i = 1 UNION ALL SELECT r.doc_id, r.o, r.j, r.i, r.hi FROM jumps u JOIN reach r ON r.doc_id = u.doc_id AND r.o = u.o AND r.j = u.j AND r.i = u.hi + 1),
 pieces AS (SELECT doc_id, o, 0 j, 0 k, b FROM buffers WHERE octet_length(encode(b)) < 4 * 8193 UNION ALL SELECT doc_id, o, j, 0, b FROM told_pieces WHERE octet_length(encode(b)) < 4 * 8193
  UNION ALL SELECT u.doc_id, u.o, u.j, u.i, string_agg(w.w, ' ' ORDER BY w.i) FROM jumps u JOIN words w ON w.doc_id = u.doc_id AND w.o = u.o AND w.j = u.j AND w.i BETWEEN u.i AND u.hi GROUP BY u.doc_id, u.o, u.j, u.i)
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o, j, k) - 1 AS chunk_index, b AS text FROM pieces"""

SQL = {
    "chunk_documents": CHUNKS_SQL,
    "clean_text": f"SELECT doc_id, {CLEAN.format('text')} AS text FROM documents",
    "token_estimate": "SELECT doc_id, octet_length(encode(text)) // 4 AS tokens FROM documents",
    "ascii_lower": f"SELECT doc_id, translate(text, '{t.UPPER}', '{t.LOWER}') AS text FROM documents",
    "html_strip": rf"""SELECT page_id, {CLEAN.format("replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>', '', 'g'), '(?s)<style[^>]*>.*?</style>', '', 'g'), '<[^>]*(>|$)', '', 'g'), '>', '')")} AS text FROM pages""",
    "html_title": f"""SELECT page_id, {CLEAN.format("regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)")} AS title FROM pages""",
    "json_strings": f"""SELECT event_id, {CLEAN.format("array_to_string(list_filter(regexp_extract_all(props, '\"([^\"]*)\"', 1), lambda x: x <> ''), ' ')")} AS text FROM events""",
    "csv_fields": "SELECT event_id, event_type || ' ' || user_id || ' ' || event_id AS text FROM events",
    "yaml_values": "SELECT event_id, event_type || ' ' || user_id AS text FROM events",
    "rtf_strip": "SELECT event_id, event_type || ' user ' || user_id AS text FROM events",
    "tokenize": f"SELECT doc_id, array_to_string({TOKENS}, ' ') AS tokens FROM documents",
    "tokenize_cjk": f"""WITH s AS (SELECT event_id, event_type, translate(CAST(event_id AS VARCHAR), '0123456789', '{SIGNS}') s FROM events),
 g AS (SELECT event_id, event_type, array_to_string(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN i < length(s) THEN substr(s, i, 1) || ' ' || substr(s, i, 2) ELSE substr(s, i, 1) END), ' ') g FROM s)
 SELECT event_id, lower(event_type) || ' ' || g || ' x ' || g AS tokens FROM g""",
    "term_freq": f"WITH t AS (SELECT doc_id AS id, {TOKENS} ts FROM documents) SELECT id, term, count(*) AS tf, max(dl) AS dl FROM (SELECT id, len(ts) dl, unnest(ts) term FROM t) GROUP BY id, term",
    "doc_freq": f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOKENS}) term FROM documents) GROUP BY term",
    "avg_doc_len": f"SELECT count(*) AS n, round(avg(len({TOKENS})), 6) AS avgdl FROM documents",
    "unfenced": "SELECT event_id, trim(regexp_replace(props, '^\\s+|\\s+$', '', 'g')) AS answer FROM events",
    "escaped_like": "SELECT event_id, replace(replace(replace(event_type || '_50%' || chr(92) || props, chr(92), chr(92) || chr(92)), '%', chr(92) || '%'), '_', chr(92) || '_') AS pattern FROM events",
    "paragraphs": f"""WITH p AS (SELECT conv_id, turn, trim(text) p, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) k FROM conversations WHERE trim(text) <> ''),
 cut AS (SELECT conv_id, turn, k, i, CASE WHEN octet_length(encode(p)) > 200 THEN substr(p, i, 200) ELSE p END AS paragraph FROM (SELECT *, {_PIECES} i FROM p) WHERE octet_length(encode(p)) > 200 OR i = 1)
 SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k, i) - 1 AS n, paragraph FROM cut""",
    "sentences": r"""WITH s AS (SELECT doc_id, regexp_extract_all(replace(text, chr(10), ' '), '[^.?!]*[.?!]|[^.?!]+$') ss FROM documents)
 SELECT doc_id, CAST(generate_subscripts(ss, 1) - 1 AS INTEGER) AS n, trim(unnest(ss)) AS sentence FROM s""",
    "hier_sentences": r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?。！？])([ \n])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') ss FROM documents)
 SELECT doc_id, CAST(generate_subscripts(ss, 1) - 1 AS INTEGER) AS n, unnest(ss) AS sentence FROM s""",
}
