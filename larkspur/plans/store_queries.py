"""Queries of stored tables: listing, chunks, orphans and deletions, wiki, graph, hierarchy, batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.text import unique_strings
from larkspur.operators import graph, hierarchy, listing
from larkspur.operators.listing import DocumentQuery
from larkspur.plans import corpus
from larkspur.plans.search_queries import TEXT_QUERIES, bm25_ctes, top_rows
from larkspur.plans.tables import by_work, table
from larkspur.plans.text_queries import EDGES
from larkspur.sources.batching import batches
from larkspur.sources.catalog import Catalog, NotFoundError
from larkspur.sources.shared import run_dir

_LISTED = ("id", "name", "file_path", "doc_type", "status", "created_at")


def scan_documents(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.documents(spark, sf).select(*_LISTED)


def scan_live_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return listing.live_chunks(corpus.chunks(spark, sf), corpus.live_documents(spark, sf)).select("id", "document_id", "label")


def list_search(spark: SparkSession, sf: str) -> DataFrame:
    return listing.select_documents(corpus.documents(spark, sf), DocumentQuery(search=" SRC1/ ")).select("id", "name", "file_path")


def list_filter_in(spark: SparkSession, sf: str) -> DataFrame:
    return listing.select_documents(corpus.documents(spark, sf), DocumentQuery(filters={"type": ["en", "fr"], "status": ["indexed"], "name": []})).select("id", "doc_type", "status")


def list_page(spark: SparkSession, sf: str) -> DataFrame:
    """The third page of 25, newest first."""
    return listing.list_documents(corpus.documents(spark, sf), DocumentQuery(limit=25, offset=listing.page_offset(25, page=3))).select("id", "created_at")


def list_offset(spark: SparkSession, sf: str) -> DataFrame:
    """All but the first 40."""
    return listing.list_documents(corpus.documents(spark, sf), DocumentQuery(offset=40)).select("id")


def list_count(spark: SparkSession, sf: str) -> DataFrame:
    return listing.count_documents(corpus.documents(spark, sf), DocumentQuery(filters={"status": ["indexed"]}, limit=1))


def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.documents(spark, sf).filter(F.col("id") == 7).select(*_LISTED)


def documents_at_path(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of exactly these paths, newest first."""
    return listing.list_documents(corpus.documents(spark, sf), DocumentQuery(filters={"path": ["src1/1.txt", "src2/22.txt", "1.txt"]})).select("id", "file_path", "created_at")


def hits_placeholder(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks with their document's name, or a placeholder where it is gone."""
    hits = corpus.chunks(spark, sf).select("id", "document_id")
    return listing.with_document(hits, corpus.live_documents(spark, sf), "(unknown)").select("id", "document_name", "file_path")


def document_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation's turns in order as one text."""
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), "text")
    return hierarchy.joined_chunks(turns)


def unique_words(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn's words once, in the order of first appearance."""
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(unique_strings(F.split("text", " ")), " ").alias("words"))


def orphan_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Relations whose ends both exist once every third supplier is gone, by type of source."""
    entities, relations = corpus.graph(spark, sf)
    kept = entities.filter(~((F.col("type") == "supplier") & (F.regexp_extract("id", r"\d+$", 0).cast("long") % 3 == 0)))
    return graph.checked_relations(relations, kept)[0].groupBy(F.substring_index("source", "-", 1).alias("kind")).agg(F.count("*").alias("relations"))


def chunk_by_index(spark: SparkSession, sf: str) -> DataFrame:
    return listing.chunk_at(corpus.chunks(spark, sf), corpus.documents(spark, sf), 3, 0).select("id", "document_id", "label")


def chunks_of_document(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), "text")
    return listing.chunks_of(turns, turns.select(F.col("document_id").alias("id")).distinct(), 1)


def embedded_only(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that have a vector; the others are for keywords alone."""
    docs = corpus.texts(spark, sf).join(corpus.chunks(spark, sf).select("id", "embedding"), "id", "left")
    return listing.embedded(docs).select("id", F.size("embedding").cast("long").alias("dimension"))


def orphan_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return listing.orphan_chunks(corpus.chunks(spark, sf), corpus.live_documents(spark, sf)).select("id", "document_id")


def orphan_count(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_chunks(spark, sf).agg(F.count("*").alias("orphans"))


def _catalog(spark: SparkSession, indexed: bool = False) -> Catalog:
    """A catalog of its own in this run's folder."""
    return Catalog(spark, f"{run_dir(spark)}/catalog-{uuid.uuid4().hex}", indexed=indexed)


def _with_orphans(spark: SparkSession, sf: str) -> Catalog:
    """Vectors as chunks of the documents of their number; then every seventh document goes without them."""
    store, chunks = _catalog(spark), _text_id(_text_id(corpus.chunks(spark, sf)), "document_id")
    there = chunks.select(F.col("document_id").alias("id")).distinct()
    store.add_documents(there.select("id", F.concat(F.lit("doc-"), "id").alias("name"), F.concat(F.lit("vectors/"), "id").alias("file_path")))
    store.add_chunks(chunks.withColumn("text", F.col("label").cast("string")))
    store.delete_documents(there.filter(F.col("id").cast("long") % 7 == 0), cascade=False)
    return store


def gc_survivors(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks by label once a catalog's orphans were deleted."""
    store = _with_orphans(spark, sf)
    store.delete_orphans()
    return store.table("chunks").groupBy(F.col("text").cast("int").alias("label")).agg(F.count("*").alias("chunks"))


def gc_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A catalog's orphans: counted, deleted, counted again; and what then is left."""
    store = _with_orphans(spark, sf)
    found, deleted, left = store.count_orphans(), store.delete_orphans(), store.count_orphans()
    return store.table("chunks").agg(F.count("*").alias("chunks")).select(F.lit(found).cast("long").alias("orphans"), F.lit(deleted).cast("long").alias("deleted"), F.lit(left).cast("long").alias("left_over"), "chunks")


def _text_id(df: DataFrame, column: str = "id") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("string"))


def cascade_survivors(spark: SparkSession, sf: str) -> DataFrame:
    """What is left when conversations of an even number go with their turns."""
    store, turns = _catalog(spark), corpus.turns(spark, sf)
    of = turns.select(F.col("document_id").alias("id")).distinct().withColumn("file_path", F.concat(F.lit("conversation/"), "id"))
    store.add_documents(_text_id(of.withColumn("name", F.col("file_path"))))
    store.add_chunks(_text_id(_text_id(turns), "document_id"))
    store.delete_documents(_text_id(of.filter(F.col("id") % 2 == 0)).select("id"))
    return store.live_chunks().groupBy(F.col("document_id").cast("long").alias("conv_id")).agg(F.count("*").alias("turns"))


def _named(docs: DataFrame) -> DataFrame:
    """One chunk for each document: its name."""
    return docs.select(F.col("id").cast("string").alias("document_id"), F.lit(0).alias("chunk_index"), F.col("name").alias("text"))


#: What is added to an id for another one of the same path.
_AGAIN = 1_000_000_000


def skip_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """What an ingestion of all documents adds where those of an even number are already there."""
    store, docs = _catalog(spark), corpus.documents(spark, sf)
    there = docs.filter(F.col("id") % 2 == 0).withColumn("id", F.col("id") + _AGAIN)
    store.ingest(_text_id(there), _named(there))
    store.ingest(_text_id(docs), _named(docs))
    return store.table("documents").select(F.col("id").cast("long").alias("id"), "file_path").filter(F.col("id") < _AGAIN)


def force_replace(spark: SparkSession, sf: str) -> DataFrame:
    """Documents after those of German paths came again under new ids."""
    store, docs = _catalog(spark), corpus.documents(spark, sf)
    new = docs.filter(F.col("doc_type") == "de").withColumn("id", F.col("id") + _AGAIN)
    store.ingest(_text_id(docs), _named(docs))
    store.ingest(_text_id(new), _named(new), force=True)
    return store.table("documents").select(F.col("id").cast("long").alias("id"), "file_path", "doc_type")


def keyword_only_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with vectors ingested for keywords alone: no chunk keeps its vector."""
    store, docs = _catalog(spark), corpus.documents(spark, sf)
    vectors = corpus.chunks(spark, sf).select(F.col("document_id").cast("string"), "embedding")
    store.ingest(_text_id(docs), _named(docs).join(vectors, "document_id", "left"), keyword_only=True)
    rows = store.table("chunks")
    return rows.groupBy(F.col("embedding").isNull().alias("without_vector")).agg(F.count("*").alias("chunks"), F.countDistinct("document_id").alias("documents"))


def all_or_nothing(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of which some have no document are refused as a whole; what is there is what was there before."""
    store, docs = _catalog(spark), corpus.documents(spark, sf)
    store.ingest(_text_id(docs.filter(F.col("id") % 2 == 0)), _named(docs.filter(F.col("id") % 2 == 0)))
    try:
        store.add_chunks(_named(docs).withColumn("chunk_index", F.lit(1)))
        refused = False
    except ValueError:
        refused = True
    return store.table("chunks").groupBy("chunk_index").agg(F.count("*").alias("chunks")).withColumn("refused", F.lit(refused))


def indexed_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 by the index that ingestion keeps: documents in two changes, then German ones replaced and French ones deleted."""
    store, texts = _catalog(spark, indexed=True), table(spark, sf, "documents").select("doc_id", "text", "lang")
    docs = texts.select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("d/"), "doc_id").alias("file_path"), F.concat(F.lit("d/"), "doc_id").alias("name"), "lang", "text")
    for odd in (0, 1):
        some = docs.filter(F.col("id").cast("long") % 2 == odd)
        store.ingest(some, _bodies(some, ""))
    german = docs.filter("lang = 'de'").withColumn("id", F.concat(F.lit("new-"), "id"))
    store.ingest(german, _bodies(german, " again"), force=True)
    store.delete_documents(docs.filter("lang = 'fr'").select("id"))
    return store.keyword_index().search(corpus.text_queries(spark, sf), 5)


def _bodies(docs: DataFrame, more: str) -> DataFrame:
    return docs.select("id", F.col("id").alias("document_id"), F.lit(0).alias("chunk_index"), F.concat("text", F.lit(more)).alias("text"))


def status_update(spark: SparkSession, sf: str) -> DataFrame:
    store, docs = _catalog(spark), _text_id(corpus.documents(spark, sf))
    store.add_documents(docs)
    store.set_statuses(docs.filter(F.col("id").cast("long") % 10 == 0).select("id", F.lit("failed").alias("status"), F.lit("every tenth").alias("error")))
    return store.table("documents").select(F.col("id").cast("long").alias("id"), "status")


def _wiki(spark: SparkSession, sf: str) -> Catalog:
    """Conversations as indexes, their turns as entries; ids are padded, so that they sort like numbers."""
    store, turns = _catalog(spark), table(spark, sf, "conversations")
    index, entry = F.format_string("%012d", F.col("conv_id").cast("long")), F.format_string("%012d-%06d", F.col("conv_id").cast("long"), F.col("turn").cast("long"))
    store.add_indexes(turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("title"), F.count("*").cast("string").alias("description")).select(index.alias("id"), "title", "description"))
    store.add_entries(turns.select(entry.alias("id"), index.alias("index_id"), F.col("role").alias("title"), F.col("text").alias("body")))
    return store


def wiki_list_indexes(spark: SparkSession, sf: str) -> DataFrame:
    return _wiki(spark, sf).indexes().select(F.col("id").cast("long").alias("id"), "title", F.col("description").cast("long").alias("entries"))


def wiki_list_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Every index's entries, newest first."""
    return _wiki(spark, sf).all_entries().select(F.col("index_id").cast("long").alias("index_id"), F.substring_index("id", "-", -1).cast("long").alias("id"), "title", "body")


def wiki_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Entries by index once two indexes went with theirs."""
    store = _wiki(spark, sf)
    for i in (1, 2):
        store.delete_index(f"{i:012d}")
    left = store.table("wiki_entries").groupBy("index_id").agg(F.count("*").alias("entries"))
    return left.join(store.indexes().select(F.col("id").alias("index_id")), "index_id", "left").select(F.col("index_id").cast("long").alias("conv_id"), "entries")


def wiki_update(spark: SparkSession, sf: str) -> DataFrame:
    store = _wiki(spark, sf)
    store.update_entry(f"{1:012d}-{0:06d}", "new title", "new body")
    return store.table("wiki_entries").select(F.col("index_id").cast("long").alias("conv_id"), F.substring_index("id", "-", -1).cast("long").alias("turn"), "title", "body")


def kg_find(spark: SparkSession, sf: str) -> DataFrame:
    return graph.find_entities(corpus.graph(spark, sf)[0], "N_1").select("id", "name", "type")


def kg_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbours(corpus.graph(spark, sf)[1])


def kg_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Relations without end once every third supplier is gone."""
    entities, relations = corpus.graph(spark, sf)
    kept = entities.filter(~((F.col("type") == "supplier") & (F.regexp_extract("id", r"\d+$", 0).cast("long") % 3 == 0)))
    return graph.checked_relations(relations, kept)[1].select("id", "source", "target")


def _names(spark: SparkSession, sf: str) -> DataFrame:
    region = table(spark, sf, "region")
    return region.select(F.col("r_regionkey").cast("long").alias("query_id"), F.col("r_name").alias("name"))


def kg_link(spark: SparkSession, sf: str) -> DataFrame:
    return graph.link_entities(corpus.graph(spark, sf)[0], _names(spark, sf))


def kg_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    """Entities around each region, two relations deep."""
    entities, relations = corpus.graph(spark, sf)
    return graph.search_graph(entities, relations, _names(spark, sf), 2)[0].select("query_id", "id", F.col("hops").cast("long").alias("hops"))


def kg_subgraph_relations(spark: SparkSession, sf: str) -> DataFrame:
    entities, relations = corpus.graph(spark, sf)
    return graph.search_graph(entities, relations, _names(spark, sf), 1)[1].select("query_id", "id")


def _first_word(prompt: str) -> str:
    """What stands in for a model: of a chunk's text the first word as an entity, of a question the last one as a name."""
    import json
    import re

    if "Question: " in prompt:
        return json.dumps([prompt.rpartition(" ")[2]])
    said = re.match(r"[^ \n]*", prompt.partition("Text:\n")[2])[0]
    first = {"id": said[:1], "name": said}
    return f"```json\n{json.dumps({'entities': [first, {'id': 'all', 'name': 'All'}], 'relations': [{'id': 'in ' + said[:1], 'source': said[:1], 'target': 'all'}, {'id': 'lost', 'source': 'all', 'target': 'nobody'}]})}\n```"


def _built(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    turns = corpus.turns(spark, sf).filter(F.regexp_extract("text", r"^[^ \n]*", 0) != "")
    return graph.build_graph(turns.select("document_id", "chunk_index", "text"), _first_word)[:2]


def kg_build(spark: SparkSession, sf: str) -> DataFrame:
    """Entities that a model finds in all turns: the last answer of an id stays, with its conversation."""
    return _built(spark, sf)[0].select("id", "name", F.col("properties")["document_id"].alias("document_id"))


def kg_build_relations(spark: SparkSession, sf: str) -> DataFrame:
    return _built(spark, sf)[1].select("id", "source", "target")


def kg_ask(spark: SparkSession, sf: str) -> DataFrame:
    """Entities around what questions name, a relation deep."""
    entities, relations = corpus.graph(spark, sf)
    asked = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("query_id"), F.concat(F.lit("What lies in "), "r_name").alias("query"))
    return graph.ask_graph(entities, relations, asked, _first_word, 1)[0].select("query_id", "id", F.col("hops").cast("long").alias("hops"))


def kg_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Entities that come twice: the later name stays."""
    entities = corpus.graph(spark, sf)[0]
    again = entities.filter(F.col("type") == "nation").withColumn("name", F.lower("name"))
    return graph.last_of(entities.withColumn("seq", F.lit(0)).unionByName(again.withColumn("seq", F.lit(1))), "seq").select("id", "name", "type")


#: Turns whose nodes a task makes: a few MB of texts that take many seconds.
TURNS_A_TASK = 5000


def hier_build(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of every conversation, with the deterministic embedder's vectors."""
    from larkspur.sources.models import hashed_embedding

    turns = by_work(table(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), "text"), "document_id", TURNS_A_TASK)
    nodes = hierarchy.build_nodes(hierarchy.joined_chunks(turns), lambda c: hashed_embedding(c, 16))
    return nodes.select("id", "document_id", F.col("layer").cast("long").alias("layer"), "text", "parent")


def _layers(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as a tree: the first of each label is a summary, each tenth a paragraph of it, the rest sentences of those."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    first = e.groupBy("label").agg(F.min("vec_id").alias("top"))
    n = e.join(F.broadcast(first), "label")
    layer = F.when(F.col("vec_id") == F.col("top"), 0).when(F.col("vec_id") % 10 == 0, 1).otherwise(2)
    kinds = n.withColumn("layer", layer)
    paragraphs = kinds.filter("layer = 1").groupBy("label").agg(F.min("vec_id").alias("middle"))
    parent = F.when(F.col("layer") == 1, F.col("top")).when(F.col("layer") == 2, F.col("middle"))
    return kinds.join(F.broadcast(paragraphs), "label", "left").select(F.col("vec_id").alias("id"), F.col("label").alias("document_id"), "layer", F.col("vec_id").cast("string").alias("text"), "embedding", parent.alias("parent"))


def hier_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes of one document's layer."""
    return hierarchy.nodes_of(_layers(spark, sf), document_id=3, layer=2).select("id", "parent")


def checked_delete(spark: SparkSession, sf: str) -> DataFrame:
    """A conversation deleted by its id, and one that isn't there, which is refused."""
    store, turns = _catalog(spark), corpus.turns(spark, sf)
    of = turns.select(F.col("document_id").alias("id")).distinct().withColumn("file_path", F.concat(F.lit("conversation/"), "id"))
    store.add_documents(_text_id(of.withColumn("name", F.col("file_path"))))
    store.add_chunks(_text_id(_text_id(turns), "document_id"))
    gone = store.delete_checked("3")
    try:
        refused = store.delete_checked("nowhere") < 0
    except NotFoundError:
        refused = True
    return store.table("chunks").agg(F.count("*").alias("turns"), F.countDistinct("document_id").alias("conversations")).select("*", F.lit(gone).cast("long").alias("deleted"), F.lit(refused).alias("refused"))


def hier_search(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.hierarchical_search(_layers(spark, sf), corpus.vector_queries(spark, sf), 3).select("query_id", "id", "document_id", F.col("layer").cast("long").alias("layer"), "score", "rank")


def embed_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of each conversation in requests of at most 4 texts and 120 estimated tokens."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return batches(turns, "conv_id", "turn", most=4, budget=120)


QUERIES = {
    f.__name__: f
    for f in (
        hier_nodes, checked_delete, gc_counts, keyword_only_ingest, all_or_nothing, indexed_ingest, wiki_cascade,
        scan_documents, scan_live_chunks, list_search, list_filter_in, list_page, list_offset, list_count, chunk_by_index, chunks_of_document, embedded_only, orphan_chunks, orphan_count, gc_survivors,
        point_lookup, documents_at_path, hits_placeholder, document_texts, unique_words, orphan_relations, cascade_survivors, skip_duplicates, force_replace, status_update, wiki_list_indexes, wiki_list_entries, wiki_update, kg_find, kg_neighbors, kg_checked, kg_link, kg_subgraph, kg_subgraph_relations, kg_build, kg_build_relations, kg_ask, kg_upsert, hier_build, hier_search, embed_batches,
    )
}

_WORDS = "words AS (SELECT conv_id, turn, regexp_extract(text, '^[^ \\n]*') w FROM conversations WHERE regexp_extract(text, '^[^ \\n]*') <> '')"
_D = f"WITH {corpus.DOCUMENTS}"
_LIVE = "(SELECT * FROM docs WHERE id % 7 <> 0)"
_TREE = """first AS (SELECT label, min(vec_id) AS top FROM embeddings GROUP BY label),
 kinds AS (SELECT e.*, top, CASE WHEN vec_id = top THEN 0 WHEN vec_id % 10 = 0 THEN 1 ELSE 2 END AS layer FROM embeddings e JOIN first USING (label)),
 mid AS (SELECT label, min(vec_id) AS middle FROM kinds WHERE layer = 1 GROUP BY label),
 nodes AS (SELECT vec_id AS id, k.label AS document_id, layer, embedding, CASE layer WHEN 1 THEN top WHEN 2 THEN middle END AS parent FROM kinds k LEFT JOIN mid m ON m.label = k.label),
 sc AS (SELECT q.vec_id AS query_id, n.id, n.document_id, n.layer, n.parent, round(list_cosine_similarity(q.embedding::DOUBLE[], n.embedding::DOUBLE[]), 9) AS score FROM embeddings q, nodes n WHERE q.vec_id % 20 = 0),
 t0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) r FROM sc WHERE layer = 0) WHERE r <= 3),
 t1 AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.id) r FROM sc s JOIN t0 ON t0.query_id = s.query_id AND t0.id = s.parent WHERE s.layer = 1) WHERE r <= 6),
 t2 AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.id) r FROM sc s JOIN t1 ON t1.query_id = s.query_id AND t1.id = s.parent WHERE s.layer = 2) WHERE r <= 3),
 whole AS (SELECT query_id, id, document_id, layer, score FROM t2 UNION ALL SELECT query_id, id, document_id, layer, round(score * 0.95, 9) FROM t1 WHERE query_id NOT IN (SELECT query_id FROM t2 GROUP BY query_id HAVING count(*) >= 3))"""
_REACH = f"""WITH RECURSIVE {corpus.GRAPH},
 adj AS (SELECT source AS a, target AS b FROM relations UNION SELECT target, source FROM relations),
 seeds AS (SELECT DISTINCT r_regionkey AS query_id, e.id FROM region r JOIN entities e ON contains(lower(e.name), lower(r.r_name))),
 walk AS (SELECT query_id, id, 0 AS hops FROM seeds UNION SELECT w.query_id, adj.b, w.hops + 1 FROM walk w JOIN adj ON adj.a = w.id WHERE w.hops < {{}}),
 reach AS (SELECT query_id, id, min(hops) AS hops FROM walk GROUP BY query_id, id)"""

SQL = {
    "scan_documents": f"{_D} SELECT * FROM docs",
    "scan_live_chunks": f"{_D} SELECT vec_id AS id, vec_id AS document_id, label FROM embeddings WHERE vec_id IN (SELECT id FROM {_LIVE})",
    "list_search": f"{_D} SELECT id, name, file_path FROM docs WHERE contains(lower(name), 'src1/') OR contains(lower(file_path), 'src1/')",
    "list_filter_in": f"{_D} SELECT id, doc_type, status FROM docs WHERE doc_type IN ('en', 'fr') AND status = 'indexed'",
    "list_page": f"{_D} SELECT id, created_at FROM docs ORDER BY created_at DESC, id DESC LIMIT 25 OFFSET 50",
    "list_offset": f"{_D} SELECT id FROM docs ORDER BY created_at DESC, id DESC OFFSET 40",
    "list_count": f"{_D} SELECT count(*) AS total FROM docs WHERE status = 'indexed'",
    "point_lookup": f"{_D} SELECT * FROM docs WHERE id = 7",
    "documents_at_path": f"{_D} SELECT id, file_path, created_at FROM docs WHERE file_path IN ('src1/1.txt', 'src2/22.txt', '1.txt') ORDER BY created_at DESC, id DESC",
    "hits_placeholder": f"{_D} SELECT vec_id AS id, coalesce(name, '(unknown)') AS document_name, coalesce(file_path, '(unknown)') AS file_path FROM embeddings e LEFT JOIN {_LIVE} d ON d.id = e.vec_id",
    "document_texts": "SELECT conv_id AS document_id, string_agg(text || chr(10), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
    "unique_words": """WITH w AS (SELECT conv_id, turn, w, min(i) i FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) w, generate_subscripts(string_split(text, ' '), 1) i FROM conversations) WHERE w <> '' GROUP BY conv_id, turn, w)
 SELECT c.conv_id, c.turn, coalesce(string_agg(w, ' ' ORDER BY i), '') AS words FROM conversations c LEFT JOIN w USING (conv_id, turn) GROUP BY c.conv_id, c.turn""",
    "orphan_relations": "SELECT 'nation' AS kind, count(*) AS relations FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier WHERE s_suppkey % 3 <> 0",
    "chunk_by_index": "SELECT vec_id AS id, vec_id AS document_id, label FROM embeddings WHERE vec_id = 3 AND vec_id IN (SELECT doc_id FROM documents)",
    "chunks_of_document": "SELECT conv_id AS document_id, turn AS chunk_index, text FROM conversations WHERE conv_id = 1 ORDER BY turn",
    "embedded_only": "SELECT doc_id AS id, len(embedding) AS dimension FROM documents JOIN embeddings ON vec_id = doc_id",
    "orphan_chunks": f"{_D} SELECT vec_id AS id, vec_id AS document_id FROM embeddings WHERE vec_id NOT IN (SELECT id FROM {_LIVE})",
    "orphan_count": f"{_D} SELECT count(*) AS orphans FROM embeddings WHERE vec_id NOT IN (SELECT id FROM {_LIVE})",
    "hier_nodes": f"WITH {_TREE} SELECT id, parent FROM nodes WHERE document_id = 3 AND layer = 2",
    "checked_delete": "SELECT count(*) FILTER (WHERE conv_id <> 3) AS turns, count(DISTINCT conv_id) FILTER (WHERE conv_id <> 3) AS conversations, count(*) FILTER (WHERE conv_id = 3) AS deleted, true AS refused FROM conversations",
    "gc_counts": "SELECT count(*) FILTER (WHERE vec_id % 7 = 0) AS orphans, count(*) FILTER (WHERE vec_id % 7 = 0) AS deleted, 0::BIGINT AS left_over, count(*) FILTER (WHERE vec_id % 7 <> 0) AS chunks FROM embeddings",
    "keyword_only_ingest": "SELECT true AS without_vector, count(*) AS chunks, count(DISTINCT doc_id) AS documents FROM documents",
    "all_or_nothing": "SELECT 0 AS chunk_index, count(*) AS chunks, true AS refused FROM documents WHERE doc_id % 2 = 0",
    "indexed_ingest": f"""WITH {bm25_ctes("SELECT CASE lang WHEN 'de' THEN 'new-' ELSE '' END || doc_id AS id, CASE lang WHEN 'de' THEN text || ' again' ELSE text END AS text FROM documents WHERE coalesce(lang, '') <> 'fr'", TEXT_QUERIES)} {top_rows("scored", 5)}""",
    "wiki_cascade": "SELECT conv_id, count(*) AS entries FROM conversations WHERE conv_id NOT IN (1, 2) GROUP BY conv_id",
    "gc_survivors": "SELECT label, count(*) AS chunks FROM embeddings WHERE vec_id % 7 <> 0 GROUP BY label",
    "cascade_survivors": "SELECT conv_id, count(*) AS turns FROM conversations WHERE conv_id % 2 <> 0 GROUP BY conv_id",
    "skip_duplicates": f"{_D} SELECT id, file_path FROM docs WHERE id % 2 <> 0",
    "force_replace": f"{_D} SELECT CASE WHEN doc_type = 'de' THEN id + 1000000000 ELSE id END AS id, file_path, doc_type FROM docs",
    "status_update": f"{_D} SELECT id, CASE WHEN id % 10 = 0 THEN 'failed' ELSE status END AS status FROM docs",
    "wiki_list_indexes": "SELECT conv_id AS id, arg_min(text, turn) AS title, count(*) AS entries FROM conversations GROUP BY conv_id ORDER BY title, id",
    "wiki_list_entries": "SELECT conv_id AS index_id, turn AS id, role AS title, text AS body FROM conversations ORDER BY conv_id, turn DESC",
    "wiki_update": "SELECT conv_id, turn, CASE WHEN conv_id = 1 AND turn = 0 THEN 'new title' ELSE role END AS title, CASE WHEN conv_id = 1 AND turn = 0 THEN 'new body' ELSE text END AS body FROM conversations",
    "kg_find": f"WITH {corpus.GRAPH} SELECT id, name, type FROM entities WHERE contains(lower(name), 'n_1')",
    "kg_neighbors": f"WITH {corpus.GRAPH} SELECT source AS id, target AS other, id AS relation_id FROM relations UNION ALL SELECT target, source, id FROM relations",
    "kg_checked": "SELECT 'supplier-' || s_suppkey || '>nation-' || s_nationkey AS id, 'supplier-' || s_suppkey AS source, 'nation-' || s_nationkey AS target FROM supplier WHERE s_suppkey % 3 = 0",
    "kg_link": f"WITH {corpus.GRAPH} SELECT DISTINCT CAST(r_regionkey AS BIGINT) AS query_id, e.id FROM region r JOIN entities e ON contains(lower(e.name), lower(r.r_name))",
    "kg_subgraph": f"{_REACH.format(2)} SELECT CAST(query_id AS BIGINT) AS query_id, id, CAST(hops AS BIGINT) AS hops FROM reach",
    "kg_subgraph_relations": f"{_REACH.format(1)} SELECT DISTINCT CAST(query_id AS BIGINT) AS query_id, r.id FROM reach JOIN relations r ON r.source = reach.id OR r.target = reach.id",
    "kg_build": f"WITH {_WORDS} SELECT w[1:1] AS id, arg_max(w, row(CAST(conv_id AS VARCHAR), turn)) AS name, arg_max(CAST(conv_id AS VARCHAR), row(CAST(conv_id AS VARCHAR), turn)) AS document_id FROM words GROUP BY 1 UNION ALL SELECT 'all', 'All', arg_max(CAST(conv_id AS VARCHAR), row(CAST(conv_id AS VARCHAR), turn)) FROM words",
    "kg_build_relations": f"WITH {_WORDS} SELECT DISTINCT 'in ' || w[1:1] AS id, w[1:1] AS source, 'all' AS target FROM words",
    "kg_ask": f"{_REACH.format(1)} SELECT CAST(query_id AS BIGINT) AS query_id, id, CAST(hops AS BIGINT) AS hops FROM reach",
    "kg_upsert": f"WITH {corpus.GRAPH} SELECT id, CASE WHEN type = 'nation' THEN lower(name) ELSE name END AS name, type FROM entities",
    "hier_build": rf"""WITH t AS (SELECT conv_id, string_agg(text || chr(10), '' ORDER BY turn) t FROM conversations GROUP BY conv_id),
 blocks AS (SELECT conv_id, list_filter(list_transform(string_split(replace(t, chr(13) || chr(10), chr(10)), chr(10) || chr(10)), lambda p: {EDGES.format("p")}), lambda p: p <> '') ps FROM t),
 cut AS (SELECT conv_id, flatten(list_transform(ps, lambda p: CASE WHEN octet_length(encode(p)) > 2000 THEN list_transform(range(1, length(p) + 1, 2000), lambda i: substr(p, i, 2000)) ELSE [p] END)) ps FROM blocks),
 paragraphs AS (SELECT conv_id, unnest(ps) text, conv_id || '-p' || (generate_subscripts(ps, 1) - 1) id FROM cut),
 told AS (SELECT conv_id, id parent, list_filter(list_transform(string_split(regexp_replace(text, '([.!?。！？])([ \n])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: {EDGES.format("x")}), lambda x: x <> '') ss FROM paragraphs),
 sentences AS (SELECT conv_id, parent, unnest(ss) text, parent || '-s' || (generate_subscripts(ss, 1) - 1) id FROM told)
 SELECT conv_id || '-summary' AS id, conv_id AS document_id, 0::BIGINT AS layer, substr(t, 1, 500) AS text, NULL::VARCHAR AS parent FROM t
 UNION ALL SELECT id, conv_id, 1, text, conv_id || '-summary' FROM paragraphs UNION ALL SELECT id, conv_id, 2, text, parent FROM sentences""",
    "embed_batches": """WITH RECURSIVE t AS (SELECT conv_id, turn, octet_length(encode(text)) // 4 n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) i FROM conversations),
 f AS (SELECT conv_id, turn, i, 1 held, n tokens, 0 batch FROM t WHERE i = 1
  UNION ALL SELECT t.conv_id, t.turn, t.i, CASE WHEN held >= 4 OR tokens + t.n > 120 THEN 1 ELSE held + 1 END, CASE WHEN held >= 4 OR tokens + t.n > 120 THEN t.n ELSE tokens + t.n END, batch + CASE WHEN held >= 4 OR tokens + t.n > 120 THEN 1 ELSE 0 END FROM f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i + 1)
 SELECT conv_id, turn, CAST(batch AS BIGINT) AS batch FROM f""",
    "hier_search": f"WITH {_TREE} SELECT query_id, id, document_id, CAST(layer AS BIGINT) AS layer, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM whole) WHERE rank <= 3",
}
