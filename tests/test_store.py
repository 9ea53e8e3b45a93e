"""Listing, the catalog and its guards, wiki, graph, hierarchy, batches."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from larkspur.operators import graph, hierarchy, listing, ordering
from larkspur.operators.listing import DocumentQuery, page_offset, parse_filters
from larkspur.plans import sinks
from larkspur.sources.batching import batches, in_batches
from larkspur.sources.catalog import Catalog, ConflictError, NotFoundError
from larkspur.sources.models import embed_chunks, hashed_embedding

DOCS = [("1", "harbour-report.pdf", "docs/harbour-report.pdf", "pdf", "indexed", 1), ("2", "tide-table.md", "tables/tide-table.md", "md", "indexed", 2), ("3", "7%_salt.txt", "docs/7%_salt.txt", "txt", "failed", 3)]


def files_read(df):
    """What the scans of a plan say when it has run once."""
    df.collect()
    plan, found = [df._jdf.queryExecution().executedPlan()], []
    while plan:
        node = plan.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            plan.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            plan.append(node.plan())
        elif node.metrics().contains("numFiles"):
            found.append((node.toString(), node.metrics().apply("numFiles").value()))
        plan += [node.children().apply(i) for i in range(node.children().size())]
    return sum(n for _, n in found)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id string, name string, file_path string, doc_type string, status string, created_at int").cache()


def found(docs, **k):
    return [r.id for r in listing.list_documents(docs, DocumentQuery(**k)).collect()]


def test_listing(docs):
    assert found(docs) == ["3", "2", "1"]
    assert found(docs, search=" REPORT ") == ["1"] and found(docs, search="%") == ["3"] and found(docs, search="docs/") == ["3", "1"] and found(docs, search="_") == ["3"]
    assert found(docs, filters={"status": ["indexed", "x"], "type": ["md", "pdf"]}) == ["2", "1"] and found(docs, filters={"name": []}) == ["3", "2", "1"]
    assert found(docs, limit=2) == ["3", "2"] and found(docs, limit=2, offset=2) == ["1"] and found(docs, offset=1) == ["2", "1"] and found(docs, offset=9) == []
    assert listing.count_documents(docs, DocumentQuery(filters={"status": ["indexed"]}, limit=1, offset=5)).first().total == 2
    for bad in ({"limit": -1}, {"offset": -1}, {"filters": {"bogus": ["x"]}}):
        with pytest.raises(ValueError):
            DocumentQuery(**bad)


def test_pages_and_flags():
    assert [page_offset(10), page_offset(10, 7), page_offset(10, 7, 3), page_offset(0, 4)] == [0, 7, 20, 4]
    for bad in ((-1, 0, 0), (1, -1, 0), (1, 0, -1), (0, 0, 2)):
        with pytest.raises(ValueError):
            page_offset(*bad)
    assert parse_filters(["a=b", " a = c=d "]) == {"a": ["b", "c=d"]}
    for bad in ("a", "=b", "a=", " = "):
        with pytest.raises(ValueError):
            parse_filters([bad])


def test_enriched_hits(spark, docs):
    hits = spark.createDataFrame([("1", 0.5), ("9", 0.4), (None, 0.1)], "document_id string, score double")
    got = {r.document_id: (r.document_name, r.file_path) for r in listing.with_document(hits, docs).collect()}
    assert got == {"1": DOCS[0][1:3], "9": ("", ""), None: ("", "")}
    assert listing.with_document(hits, docs, "(unknown)").filter("document_id = '9'").first().document_name == "(unknown)"


class Clock:
    now = datetime(2024, 1, 1, tzinfo=UTC)

    def __call__(self):
        self.now += timedelta(seconds=1)
        return self.now


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, f"file://{tmp_path}/store", Clock())


def chunk(i, d, **k):
    return {"id": i, "document_id": d, "text": f"text {i}", "chunk_index": 0, **k}


def test_cascade_and_orphans(catalog):
    catalog.add_documents([{"id": "a", "name": "a", "file_path": "p/a"}, {"id": "b", "name": "b", "file_path": "p/b"}])
    catalog.add_chunks([chunk("1", "a", embedding=[1.0, 2.5]), chunk("2", "a", embedding=[]), chunk("3", "a"), chunk("4", "b")])
    assert [r.embedding for r in catalog.table("chunks").orderBy("id").collect()] == [[1.0, 2.5], None, None, None]
    with pytest.raises(ValueError):
        catalog.add_chunks([chunk("5", "b"), chunk("6", "zzz")])
    catalog.add_chunks([])
    assert catalog.table("chunks").count() == 4
    assert catalog.delete_document("zzz") == 0
    with pytest.raises(NotFoundError):
        catalog.delete_checked("zzz")
    assert catalog.delete_checked("a") == 3
    assert [r.id for r in catalog.table("chunks").collect()] == ["4"] and [r.id for r in catalog.table("documents").collect()] == ["b"]
    catalog._commit({"documents": [catalog._keys(["b"], "documents")]})
    assert catalog.count_orphans() == 1 and catalog.live_chunks().count() == 0
    assert catalog.delete_orphans() == 1 and catalog.delete_orphans() == 0


def test_status_paths_and_close(catalog):
    catalog.add_documents([{"name": "a", "file_path": "x/a", "status": "indexing"}])
    catalog.add_documents([{"id": "new", "name": "a2", "file_path": "x/a", "status": "indexing"}, {"id": "o", "name": "o", "file_path": "a"}])
    assert [r.name for r in catalog.documents_at("x/a").collect()] == ["a2", "a"]
    catalog.set_status("new", "indexed")
    catalog.set_status("nobody", "indexed")
    row = catalog.document("new")
    assert row.status == "indexed" and row.updated_at > row.created_at and catalog.document("nobody") is None
    catalog.close()
    with pytest.raises(RuntimeError):
        catalog.table("documents")


def test_vacuum(catalog):
    assert catalog.vacuum() == 0
    for i in range(3):
        catalog.add_documents([{"id": str(i), "name": "n", "file_path": f"p/{i}"}])
    assert catalog.vacuum() == 2 and catalog.vacuum() == 0 and catalog.table("documents").count() == 3
    catalog.compact("documents", "chunks")
    assert catalog.vacuum() == 4 and catalog.vacuum() == 0 and catalog.table("documents").count() == 3


def _parts(catalog, name):
    return [e.get("add") or e.get("hide") for e in catalog._logs(catalog.version()).get(name, [])]


def test_changes_add_parts(catalog, spark):
    catalog.add_documents([{"id": str(i), "name": "n", "file_path": f"p/{i}"} for i in range(5)])
    catalog.add_chunks([chunk(f"c{i}", str(i % 5)) for i in range(10)])
    documents, chunks = _parts(catalog, "documents"), _parts(catalog, "chunks")
    catalog.set_status("3", "failed", "why")
    catalog.delete_document("4")
    catalog.add_documents([{"id": "4", "name": "again", "file_path": "p/4"}])
    assert _parts(catalog, "documents")[:1] == documents and _parts(catalog, "chunks")[:1] == chunks  # nothing was written anew
    assert {(r.id, r.name, r.status, r.error) for r in catalog.table("documents").collect()} == {*((str(i), "n", None, None) for i in range(3)), ("3", "n", "failed", "why"), ("4", "again", None, None)}
    assert catalog.table("chunks").count() == 8 and catalog.table("chunks", 2).count() == 10
    before = sorted(catalog.table("documents").collect())
    catalog.compact("documents")
    assert sorted(catalog.table("documents").collect()) == before and len(_parts(catalog, "documents")) == 1


def test_two_writers(spark, tmp_path):
    one, two = (Catalog(spark, f"file://{tmp_path}/store", Clock()) for _ in "ab")
    one.add_documents([{"id": "a", "name": "a", "file_path": "p/a"}])
    put, late = one._put, []

    def meanwhile(version, logs):
        if not late:  # another writer puts its manifest between this one's reading and writing
            late.append(version)
            two.add_documents([{"id": "b", "name": "b", "file_path": "p/b"}])
        return put(version, logs)

    one._put = meanwhile
    one.add_documents([{"id": "c", "name": "c", "file_path": "p/c"}])
    assert late and {r.id for r in one.table("documents").collect()} == {"a", "b", "c"}
    late.clear()
    docs = spark.createDataFrame([("x", "b2", "p/b"), ("y", "d", "p/d")], "id string, name string, file_path string")
    parts = spark.createDataFrame([("x", 0, "t"), ("y", 0, "t")], "document_id string, chunk_index int, text string")
    two.delete_document("b")

    def first(version, logs):
        if not late:
            late.append(version)
            two.ingest(docs.filter("id = 'x'"), parts)
        return put(version, logs)

    one._put = first
    assert one.ingest(docs, parts) == 1  # the other's path is seen after all
    assert {r.id for r in one.table("documents").collect()} == {"a", "c", "x", "y"} and one.table("chunks").count() == 2
    with pytest.raises(ConflictError):
        one._commit({"documents": []}, seen=1)


def test_ingest_skips_and_replaces(catalog, spark):
    docs = spark.createDataFrame([("d1", "f", "p/f")], "id string, name string, file_path string")
    parts = spark.createDataFrame([("d1", 0, "one", [0.5]), ("d1", 1, "two", [0.5]), ("else", 0, "no", [0.1])], "document_id string, chunk_index int, text string, embedding array<float>")
    done = catalog.ingest_measured(docs, parts)
    assert (done.documents, done.chunks) == (1, 2) and done.seconds > 0 and done.rate == done.chunks / done.seconds and catalog.ingest(docs, parts) == 0
    assert catalog.table("chunks").count() == 2 and catalog.document("d1").status == "indexed"
    again = docs.withColumn("id", F.lit("d2"))
    assert catalog.ingest(again, parts.withColumn("document_id", F.lit("d2")), force=True, keyword_only=True) == 1
    assert [r.id for r in catalog.table("documents").collect()] == ["d2"]
    assert [r.embedding for r in catalog.table("chunks").collect()] == [None] * 3

    class Broken(Exception):
        pass

    bad = parts.withColumn("text", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        catalog.ingest(docs.withColumn("file_path", F.lit("other")).withColumn("id", F.lit("d3")), bad.withColumn("document_id", F.lit("d3")))
    assert [r.id for r in catalog.table("documents").collect()] == ["d2"]


def test_failed_batches_leave_their_documents_out(spark, tmp_path):
    store = Catalog(spark, f"file://{tmp_path}/failing", indexed=True)
    docs = spark.createDataFrame([(f"d{i}", f"d{i}", f"p/{i}") for i in range(6)], "id string, name string, file_path string")
    rows = [(f"d{i}", c, f"text {i} {c}" + (" poison" if (i, c) in ((1, 2), (4, 0)) else "")) for i in range(6) for c in range(4)]
    chunks = spark.createDataFrame(rows, "document_id string, chunk_index int, text string").coalesce(1).sortWithinPartitions("document_id", "chunk_index")

    def embed(texts):
        if any("poison" in t for t in texts):
            raise OSError("refused")
        return [[float(len(t)), 1.0] for t in texts]

    told = embed_chunks(chunks, embed, tolerant=True, most=3)
    assert told.agg(F.sum("batch_failed"), F.count("error")).first() == (2, 6)
    done = store.ingest_measured(docs, told)
    # batches of three: the poisoned ones hold chunks of d1 and d2, and of d3 and d4
    assert (done.failed, done.dropped, done.documents, done.chunks) == (2, 4, 2, 8) and done.rate > 0
    assert {r.id for r in store.table("documents").collect()} == {"d0", "d5"} and store.table("chunks").filter("embedding is null").count() == 0
    assert store.keyword_index().lengths().count() == 8
    with pytest.raises(Exception, match="refused"):
        store.ingest_measured(docs.withColumn("file_path", F.concat(F.lit("q"), "id")).withColumn("id", F.concat(F.lit("x"), "id")), embed_chunks(chunks.withColumn("document_id", F.concat(F.lit("x"), "document_id")), embed))
    assert store.table("documents").count() == 2


def test_progress_is_told(spark):
    said = []
    with sinks.Watch(spark, said.append, every=0.05):
        spark.range(0, 40, 1, 8).mapInPandas(lambda it: ([__import__("time").sleep(0.3), b][1] for b in it), "id long").count()
    assert said and all(line.endswith(" left") and "/" in line for line in said)
    assert sinks.tasks_left(3, 12, 6.0) == "3/12 tasks, 18s left" and sinks.tasks_left(0, 12, 6.0) == "0/12 tasks, unknown left"


def test_searches_prune_parts(spark, tmp_path):
    store = Catalog(spark, f"file://{tmp_path}/filtered", indexed=True)
    for n in range(4):
        docs = spark.createDataFrame([(f"d{n}-{i}", f"name{n}-{i}.txt", f"folder{n}/{i}") for i in range(5)], "id string, name string, file_path string").coalesce(1)
        store.ingest(docs, docs.select(F.col("id").alias("document_id"), F.lit(0).alias("chunk_index"), F.concat(F.lit(f"Common words and Needle{n} "), "id").alias("text")).coalesce(1))
    assert files_read(store.chunks_containing("nEEDLE2 d")) == 1
    assert {r.document_id for r in store.chunks_containing("nEEDLE2 d").collect()} == {f"d2-{i}" for i in range(5)}
    assert files_read(store.chunks_like("needle_ d%-3")) == 4 and {r.document_id for r in store.chunks_like("needle_ d%-3").collect()} == {f"d{n}-3" for n in range(4)}
    assert files_read(store.chunks_containing("nowhere")) == 0 and store.chunks_containing("and").count() == 20
    assert files_read(store.list_documents(DocumentQuery(search="FOLDER3"))) == 1
    assert {r.id for r in store.list_documents(DocumentQuery(search="FOLDER3")).collect()} == {f"d3-{i}" for i in range(5)}
    store.delete_documents(["d2-0", "d3-1"])
    assert store.chunks_containing("needle2").count() == 4 and store.list_documents(DocumentQuery(search="folder3", limit=9)).count() == 4
    store.compact("chunks", "documents")
    store.vacuum()
    assert store.chunks_containing("needle2").count() == 4 and files_read(store.chunks_containing("nowhere")) == 0
    assert len([p for p in (tmp_path / "filtered").iterdir() if p.name.startswith("filters-")]) == 2


def test_wiki(catalog):
    one = catalog.add_index("b title", "about")
    catalog.add_index("a title", index_id="two")
    assert [r.title for r in catalog.indexes().collect()] == ["a title", "b title"]
    first, second = catalog.add_entry(one, "t1", "b1"), catalog.add_entry(one, "t2", "b2")
    assert [r.id for r in catalog.entries(one).collect()] == [second, first]
    catalog.update_entry(first, "t", "b")
    catalog.update_entry("unknown", "t", "b")
    assert (catalog.entry(first).title, catalog.entry(first).body) == ("t", "b")
    for call in (lambda: catalog.add_entry("no", "t", "b"), lambda: catalog.entries("no")):
        with pytest.raises(NotFoundError):
            call()
    with pytest.raises(ValueError):
        catalog.update_entry("", "t", "b")
    catalog.delete_entry(second)
    assert catalog.entry(second) is None
    catalog.delete_index(one)
    assert catalog.index(one) is None and catalog.entry(first) is None and catalog.index("two") is not None


def test_graph(spark):
    entities = spark.createDataFrame([(f"e{i}", n, "T") for i, n in enumerate(["Go Language", "Python Language", "Go Programming", "x"], 1)], "id string, name string, type string")
    relations = spark.createDataFrame([(f"r{i}", f"e{i}", f"e{i + 1}", "next") for i in (1, 2, 3)], "id string, source string, target string, type string")
    seeds = spark.createDataFrame([(0, "e1"), (0, "gone")], "query_id long, id string")
    for hops, es, rs in ((1, {"e1", "e2"}, {"r1", "r2"}), (2, {"e1", "e2", "e3"}, {"r1", "r2", "r3"}), (0, {"e1", "e2", "e3"}, {"r1", "r2", "r3"})):
        a, b = graph.subgraph(entities, relations, seeds, hops)
        assert {r.id for r in a.collect()} == es and {r.id for r in b.collect()} == rs
    assert {r.id for r in graph.find_entities(entities, "go").collect()} == {"e1", "e3"}
    assert graph.outgoing(relations, "e2").first().id == "r2" and graph.incoming(relations, "e2").first().id == "r1"
    none = graph.search_graph(entities, relations, spark.createDataFrame([(0, "zzz"), (0, "")], "query_id long, name string"))
    assert none[0].count() == 0 and none[1].count() == 0
    circle = relations.unionByName(spark.createDataFrame([("r4", "e4", "e1", "next")], relations.schema))
    assert {(r.id, r.hops) for r in graph.reached(circle, seeds.filter("id = 'e1'"), 9).collect()} == {("e1", 0), ("e2", 1), ("e4", 1), ("e3", 2)}


def test_adjacency_with_a_hub(spark):
    hub = spark.range(5000).select(F.concat(F.lit("a"), "id").alias("id"), F.lit("hub").alias("source"), F.concat(F.lit("n"), "id").alias("target"))
    chain = spark.range(4).select(F.concat(F.lit("c"), "id").alias("id"), F.concat(F.lit("n"), "id").alias("source"), F.concat(F.lit("m"), "id").alias("target"))
    relations = hub.unionByName(chain).unionByName(chain.withColumn("id", F.concat(F.lit("again"), "id")))
    table = graph.Adjacency(relations, hub=100)
    rows = table.table().filter("id = 'hub'").select(F.size("others").alias("n")).collect()
    assert 40 <= len(rows) <= 60 and sum(r.n for r in rows) == 5000 and max(r.n for r in rows) < 200
    # beyond what is sent, the frontier alone is shuffled: the table is in buckets of its key
    big = spark.range(20).select(F.lit(0).cast("long").alias("query_id"), F.concat(F.lit("n"), "id").alias("id")).hint("merge")
    plan = table.table().hint("merge").join(big, "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    table.drop()
    seeds = spark.createDataFrame([(0, "m0"), (1, "hub")], "query_id long, id string")
    got = graph.reached(relations, seeds, 3, hub=100).groupBy("query_id", "hops").count().collect()
    assert {(r.query_id, r.hops): r["count"] for r in got} == {(0, 0): 1, (0, 1): 1, (0, 2): 1, (0, 3): 4999, (1, 0): 1, (1, 1): 5000, (1, 2): 4}


def test_names_link_without_pairs(spark, monkeypatch):
    from larkspur.operators import matching

    rows = [("a", "ÉCOLE de la Mer"), ("b", "ocean Mer mer"), ("c", None), ("d", ""), ("e", "x" * 5000 + "needle"), ("f", "aaa")]
    entities = spark.createDataFrame(rows, "id string, name string")
    asked = [(0, "mer"), (0, "école"), (1, "NEEDLE"), (2, "aa"), (2, "a"), (3, ""), (4, None), (5, "zzz"), (6, "ocean mer mer "), (7, "mer")]
    names = spark.createDataFrame(asked, "query_id long, name string")
    want = {(q, i) for q, n in asked if n for i, t in rows if t and n.lower() in t.lower()}
    linked = graph.link_entities(entities, names)
    assert {tuple(r) for r in linked.collect()} == want and linked.count() == len(want)
    assert "NestedLoop" not in linked._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(matching, "MOST_KEYS", 20)
    assert {tuple(r) for r in graph.link_entities(entities, names).collect()} == want
    assert graph.link_entities(entities, names.limit(0)).count() == 0


def test_graph_from_answers(spark):
    answers = [("d1", 1, '```json\n{"entities": [{"id": "a", "name": "A", "type": "x"}, {"id": "b", "name": "B", "properties": {"k": "v"}}], "relations": [{"id": "r", "source": "a", "target": "b"}, {"id": "s", "source": "a", "target": "zzz"}]}\n```'), ("d2", 2, '{"entities": [{"id": "a", "name": "A2"}]}'), ("d3", 3, "no json")]
    es, rs, bad = graph.parsed_answers(spark.createDataFrame(answers, "document_id string, seq int, answer string"))
    got = {r.id: (r.name, r.properties) for r in es.collect()}
    assert got == {"a": ("A2", {"document_id": "d2"}), "b": ("B", {"k": "v", "document_id": "d1"})}
    assert [r.id for r in rs.collect()] == ["r"] and [r.document_id for r in bad.collect()] == ["d3"]


def test_graph_by_a_model(spark):
    chunks = spark.createDataFrame([("d1", 0, "A knows B"), ("d1", 1, "fails"), ("d2", 0, "A again")], "document_id string, chunk_index int, text string")

    def complete(prompt):
        if "Question:" in prompt:
            return '```json\n["know-a", ""]\n```' if "who" in prompt else "no idea"
        if "fails" in prompt:
            raise RuntimeError("out of reach")
        name = "KNOW-A2" if "again" in prompt else "KNOW-A"
        return '{"entities": [{"id": "a", "name": "%s"}, {"id": "b", "name": "B"}], "relations": [{"id": "r", "source": "a", "target": "b"}]}' % name

    entities, relations, bad = graph.build_graph(chunks, complete)
    assert {r.id: (r.name, r.properties["document_id"]) for r in entities.collect()} == {"a": ("KNOW-A2", "d2"), "b": ("B", "d2")}
    assert [r.id for r in relations.collect()] == ["r"] and [(r.document_id, "out of reach" in r.error) for r in bad.collect()] == [("d1", True)]
    asked = spark.createDataFrame([(0, "who is A"), (1, "nothing")], "query_id long, query string")
    found, links = graph.ask_graph(entities, relations, asked, complete, 1)
    assert {(r.query_id, r.id) for r in found.collect()} == {(0, "a"), (0, "b")} and [(r.query_id, r.id) for r in links.collect()] == [(0, "r")]


def test_hierarchy(spark):
    texts = spark.createDataFrame([("d1", "Cats purr. Cats sleep.\n\nDogs bark! They run."), ("d2", "Stocks fell. Bonds rose.")], "document_id string, text string")
    nodes = hierarchy.build_nodes(texts, lambda c: hashed_embedding(c, 64)).cache()
    assert {r.layer: r["count"] for r in nodes.groupBy("layer").count().collect()} == {0: 2, 1: 3, 2: 6}
    assert {r.id for r in hierarchy.nodes_of(nodes, "d1", 1).collect()} == {"d1-p0", "d1-p1"}
    q = spark.createDataFrame([(0, "bonds rose")], "query_id long, q string").select("query_id", hashed_embedding(F.col("q"), 64).alias("query_vec"))
    got = hierarchy.hierarchical_search(nodes, q, 2).orderBy("rank").collect()
    assert got[0].text == "Bonds rose." and len(got) == 2 and len({(r.document_id, r.text) for r in got}) == 2
    more = hierarchy.hierarchical_search(nodes, q, 9).collect()
    assert {r.layer for r in more} == {1, 2}
    chunks = spark.createDataFrame([("d", 1, "b"), ("d", 0, "a")], "document_id string, chunk_index int, text string")
    assert hierarchy.joined_chunks(chunks).first().text == "a\nb\n"
    with pytest.raises(Exception, match="summary"):
        hierarchy.build_nodes(texts, lambda c: F.lit(None).cast("array<double>")).collect()


def test_batches(spark):
    texts = ["x" * 8, "y" * 40, "z" * 4, "", "w" * 400, "v"]
    plain = list(in_batches(texts, 3, 12))
    assert [len(p) for p in plain] == [2, 2, 1, 1]
    rows = spark.createDataFrame([("g", i, t) for i, t in enumerate(texts)], "g string, i int, text string")
    got = [r.batch for r in batches(rows, "g", "i", 3, 12).orderBy("i").collect()]
    assert got == [n for n, p in enumerate(plain) for _ in p]


@pytest.mark.parametrize(("most", "budget", "slice_", "fan"), [(3, 12, 4, 2), (5, 30, 5, 3), (1, 5, 2, 2), (7, 0, 16, 64)])
def test_batches_over_many_slices(spark, most, budget, slice_, fan):
    rnd = random.Random(most)
    groups = {g: [rnd.choice(["", "x" * rnd.randint(0, 9), "y" * rnd.randint(0, 90)]) for _ in range(n)] for g, n in (("a", 1), ("b", 200), (None, 33), ("c", slice_), ("d", 2 * slice_ + 1), ("e", 97))}
    rows = spark.createDataFrame([(g, i, t) for g, ts in groups.items() for i, t in enumerate(ts)], "grp string, i int, text string").repartition(3)
    got = {(r.grp, r.i): r.batch for r in batches(rows, "grp", "i", most, budget, slice_, fan).collect()}
    assert got == {(g, i): n for g, ts in groups.items() for i, n in enumerate(n for n, p in enumerate(in_batches(ts, most, budget)) for _ in p)}


def test_one_long_group_is_many_tasks(spark):
    rows = spark.range(300_000).select(F.lit("g").alias("g"), "id", F.repeat(F.lit("x"), (F.xxhash64("id") % 200 + 200).cast("int")).alias("text"))
    done = batches(rows, "g", "id", 100, 3000).withColumn("task", F.spark_partition_id())
    got = done.agg(F.count("*").alias("n"), F.countDistinct("task").alias("tasks"), F.max("batch").alias("last")).first()
    sizes = [r.n for r in rows.orderBy("id").select(F.floor(F.octet_length("text") / 4).alias("n")).collect()]
    batch, held, tokens, total = 0, 0, 0, 0
    for n in sizes:
        if held and (held >= 100 or tokens + n > 3000):
            batch, held, tokens = batch + 1, 0, 0
        held, tokens, total = held + 1, tokens + n, total + batch
    assert (got.n, got.last) == (300_000, batch) and got.tasks > 1 and done.agg(F.sum("batch")).first()[0] == total


def test_places_in_an_order(spark):
    rows = [(i * 7 % 100 // 3, None if i % 9 == 0 else i % 4, i) for i in range(100)]
    df = spark.createDataFrame(rows, "o int, g int, i int").repartition(7)
    whole = sorted(rows, key=lambda r: (r[0], r[2]))
    got = ordering.numbered(df, [F.col("o").asc(), F.col("i").asc()], parts=5).collect()
    assert {r.i: r.place for r in got} == {r[2]: n for n, r in enumerate(whole)}
    got = ordering.numbered(df, [F.col("o").desc(), F.col("i").asc()], "g", parts=5).collect()
    for g in (None, 0, 1, 2, 3):
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[0], r[2]))
        assert {r.i: r.place for r in got if r.g == g} == {r[2]: n for n, r in enumerate(own)}
    page = ordering.after_first(df, [F.col("o").asc(), F.col("i").asc()], 37, 20)
    assert [r.i for r in page.collect()] == [r[2] for r in whole[37:57]]
    assert [r.i for r in ordering.after_first(df, [F.col("o").asc(), F.col("i").asc()], 90).collect()] == [r[2] for r in whole[90:]]
    assert ordering.after_first(df, [F.col("o").asc()], 100).count() == 0 and ordering.numbered(df.limit(0), [F.col("o").asc()]).count() == 0


def test_deep_pages_are_no_single_task(spark, docs, monkeypatch):
    whole = [r.id for r in listing.list_documents(docs).collect()]
    rest = listing.list_documents(docs, DocumentQuery(offset=1))
    plan = rest._jdf.queryExecution().executedPlan().toString()
    assert [r.id for r in rest.collect()] == whole[1:] and "CollectLimit" not in plan and "TakeOrdered" not in plan and "SinglePartition" not in plan.split("BroadcastExchange")[0]
    monkeypatch.setattr(listing, "MOST_SORTED", 1)
    assert [r.id for r in listing.list_documents(docs, DocumentQuery(limit=2, offset=1)).collect()] == whole[1:3]
    pages, last = [], None
    while page := listing.documents_after(docs, last, 2).collect():
        pages += [r.id for r in page]
        last = (page[-1].created_at, page[-1].id)
    assert pages == whole


def test_shared_tables(spark):
    from larkspur.sources.shared import discard, written

    t = written(spark.range(3), "numbers")
    assert t.count() == 3
    discard(t, t, spark.range(1))
    with pytest.raises(Exception):
        spark.read.parquet(t.inputFiles()[0]).count()


def test_nodes_are_made_by_all_cores(spark):
    from larkspur.plans import store_queries

    plan = store_queries.hier_build(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
