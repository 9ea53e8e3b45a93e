"""Retrieval: exact numbers of small cases, order, fallbacks and the pipeline with stand-in models."""

import math

import pytest
from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.functions import vectors as v
from larkspur.operators import bm25, corrective, fusion, hierarchy, inverted, listing, retrieval, rewrite, skipping, vector_search
from larkspur.operators.inverted import KeywordIndex
from larkspur.operators.retrieval import Retriever, SearchOptions
from larkspur.operators.skipping import TextFilters, literals, write_filters
from larkspur.plans import search_queries
from larkspur.sources.models import heuristic_evaluator, rule_rewriter

CHUNKS = [(1, 10, 0, "machine learning is a subset", [1.0, 0.0, 0.0]), (2, 10, 1, "deep learning neural networks", [0.9, 0.1, 0.0]), (3, 11, 0, "cooking recipes for learning the machine", None), (4, 12, 0, "机器学习算法", [0.0, 1.0, 0.0])]
SCHEMA = "id long, document_id long, chunk_index int, text string, embedding array<float>"


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, SCHEMA).cache()


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def test_bm25_exact(spark, chunks):
    got = {r.id: r.score for r in bm25.bm25_search(chunks, queries(spark, "machine machine zzz"), 5).collect()}
    lengths = [5, 4, 6, 11]
    idf = math.log((4 - 2 + 0.5) / (2 + 0.5) + 1)
    want = {i: 2 * idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * n / (sum(lengths) / 4))) for i, n in ((1, 5), (3, 6))}
    assert got == pytest.approx(want, abs=1e-8)


def test_bm25_cjk_and_limits(spark, chunks):
    got = bm25.bm25_search(chunks, queries(spark, "机器", "", "learning"), 2).collect()
    assert [(r.query_id, r.id) for r in got if r.query_id == 0] == [(0, 4)]
    assert len([r for r in got if r.query_id == 2]) == 2 and not [r for r in got if r.query_id == 1]


def test_golden_bm25(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    got = bm25.bm25_search(docs, queries(spark, "and the is and"), 5).orderBy("rank").collect()
    assert [(r.id, round(r.score, 8)) for r in got] == [(500, 5.19194347), (758, 5.16284926), (653, 5.12273031), (881, 5.11962432), (140, 5.09883313)]


def test_vectors(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([1.0], [1.0, 2.0]), ([], []), ([0.0], [1.0]), (None, [1.0]), ([3.0, 4.0], [4.0, 3.0])]
    got = spark.createDataFrame(rows, "a array<float>, b array<float>").select(v.cosine(F.col("a"), F.col("b")).alias("c"), v.dot(F.col("a"), F.col("b")).alias("d"), v.l2_normalized(F.col("a")).alias("u")).collect()
    assert [round(r.c, 6) for r in got] == [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.96]
    assert [r.d for r in got] == [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 24.0]
    assert got[-1].u == pytest.approx([0.6, 0.8]) and got[4].u == [0.0]


def test_vector_search_guards(spark, chunks):
    odd = chunks.unionByName(spark.createDataFrame([(5, 1, 0, "", [1.0]), (6, 1, 1, "", []), (7, 1, 2, "", [0.0, 0.0, 0.0])], SCHEMA))
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [1.0]), (2, None)], "query_id long, query_vec array<float>")
    got = vector_search.vector_search(odd, q, 5, 0.5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in got] == [(0, 1), (0, 2), (1, 5)]
    pairs = odd.crossJoin(q.filter("query_id = 0")).filter(F.size("embedding") == F.size("query_vec"))
    assert pairs.filter(v.cosine(F.col("embedding"), F.col("query_vec")) > 0).count() == 2
    assert vector_search.vector_search(odd, q.limit(0), 5).count() == 0


@pytest.mark.parametrize("cosines", [True, False])
def test_vector_search_by_tiles_and_cells(spark, monkeypatch, cosines):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    longer = F.transform("embedding", lambda x: x * (F.col("id") % 7 + 1))
    e = e.withColumn("embedding", F.when(F.col("id") % 3 == 0, longer).otherwise(F.slice("embedding", 1, 10))).repartition(5)
    q = e.filter("id % 5 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    q = q.unionByName(q.filter("query_id % 10 = 0").withColumn("query_vec", F.reverse("query_vec")))  # two vectors of a query
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    sent = vector_search.vector_search(e, q, 3, None, cosines)
    pairs = vector_search.similar_pairs(e, q, 0.4, cosines)
    want, want_pairs = sorted(sent.collect()), sorted(pairs.collect())
    brute = e.join(q, F.size("embedding") == F.size("query_vec")).select("query_id", "id", F.round((v.cosine if cosines else v.dot)(F.col("embedding"), F.col("query_vec")), 9).alias("score"))
    assert sorted((r.query_id, r.id, round(r.score, 6)) for r in brute.filter("score >= 0.4").collect()) == [(r.query_id, r.id, round(r.score, 6)) for r in want_pairs]
    assert plan(sent).count("FileScan parquet") == 2 and "NestedLoop" not in plan(sent) and "Cartesian" not in plan(sent)
    for name, value in (("TILE", 16), ("MOST_SENT", 0), ("VECTOR_STRIP", 3), ("QUERY_STRIP", 2), ("MOST_HELD", 10)):
        monkeypatch.setattr(vector_search, name, value)
    monkeypatch.setattr(vector_search.tiles, "__defaults__", (16,))
    assert sorted(vector_search.vector_search(e, q, 3, None, cosines).collect()) == want
    assert sorted(vector_search.similar_pairs(e, q, 0.4, cosines).collect()) == want_pairs
    assert "NestedLoop" not in plan(vector_search.vector_search(e, q, 3, None, cosines))


def test_nearest_by_names(spark):
    rows = [(f"n{i:02d}", [float(i % 5) - 2, 1.0]) for i in range(30)] + [("zero", [0.0, 0.0]), ("other", [1.0]), ("none", None)]
    nodes = spark.createDataFrame(rows, "id string, embedding array<double>").repartition(4)
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0])], "query_id long, query_vec array<double>")
    got = vector_search.nearest(nodes, asked, 20).orderBy("query_id", "rank").collect()
    names = lambda of: [r[0] for r in sorted((r for r in rows if r[0][0] == "n" and r[0] != "none"), key=lambda r: (-of * r[1][0] / math.hypot(*r[1]), r[0]))]
    zero = lambda xs: sorted([*xs[12:18], "zero"])
    for q, sign in ((0, 1), (1, -1)):
        own = names(sign)
        assert [r.id for r in got if r.query_id == q] == [*own[:12], *zero(own), *own[18:]][:20]


def test_what_is_sent_is_weighed(spark):
    from larkspur.operators import bounded

    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    wide = spark.range(4).select("id", F.array_repeat(F.lit(1.5), 1000).alias("v"), F.lit("x" * 100).alias("t"))
    assert "broadcast" in plan(bounded.sent(wide)) and "broadcast" not in plan(bounded.sent(wide, most_bytes=10_000)) and "broadcast" not in plan(bounded.sent(wide, 3))


def test_norms_pass_tiles_over():
    import numpy as np

    best = vector_search._Best(np.arange(2), np.eye(2), 1, -np.inf, 9, cosines=False)
    best.meet(np.array([7]), np.array([[9.0, 8.0]]), 12.1)
    held = best.held.copy()
    best.meet(np.array([8]), np.array([[np.nan, np.nan]]), 7.9)  # isn't looked at: no norm of it reaches what is kept
    assert (best.held == held).all() and sorted(best.held["score"]) == [8.0, 9.0]
    best.meet(np.array([9]), np.array([[1.0, 8.5]]), 8.6)
    assert sorted(best.held["score"]) == [8.5, 9.0]


def test_tasks_keep_only_their_best(spark):
    same = spark.range(0, 30_000, 1, 2).select("id", F.array(F.lit(1.0), (F.col("id") % 3).cast("double")).alias("embedding"))
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, query_vec array<double>")
    assert vector_search._scored(same, q, 4, None, True, 9).count() == 8  # ties are many, what leaves a task isn't
    assert [(r.id, r.score) for r in vector_search.vector_search(same, q, 4).orderBy("rank").collect()] == [(0, 1.0), (3, 1.0), (6, 1.0), (9, 1.0)]
    pairs = vector_search.similar_pairs(same, q, 0.9)
    assert pairs.count() == 10_000 and pairs.agg(F.min("score")).first()[0] == 1.0


def test_large_sides_are_not_sent(spark, chunks, monkeypatch):
    from larkspur.operators import bounded

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    few = spark.range(3).withColumnRenamed("id", "k")
    assert "Broadcast" in plan(spark.range(9).join(bounded.sent(few), F.col("id") == F.col("k")))
    want = sorted(bm25.bm25_search(chunks, queries(spark, "machine learning", "recipes"), 3).collect())
    monkeypatch.setattr(bounded.sent, "__defaults__", (0, 0))
    assert sorted(bm25.bm25_search(chunks, queries(spark, "machine learning", "recipes"), 3).collect()) == want


def test_bm25_reads_chunks_once(spark, tmp_path, monkeypatch):
    from larkspur.operators import bm25 as module

    made = []
    monkeypatch.setattr(module, "written", lambda df, name: made.append((name, df._jdf.queryExecution().executedPlan().toString())) or df.cache())
    spark.createDataFrame(CHUNKS, SCHEMA).write.parquet(f"{tmp_path}/chunks")
    found = module.bm25_search(spark.read.parquet(f"{tmp_path}/chunks"), queries(spark, "machine"), 3)
    assert found.count() == 2 and dict(made)["postings"].count("FileScan parquet") == 1


def test_rrf_numbers(spark):
    a = spark.createDataFrame([(0, "a", 1), (0, "b", 2)], "query_id long, id string, rank long")
    b = spark.createDataFrame([(0, "b", 1), (0, "c", 2)], "query_id long, id string, rank long")
    got = {r.id: r.score for r in fusion.reciprocal_rank_fusion(a, b).collect()}
    assert got == {"b": 0.032522475, "a": 0.016393443, "c": 0.016129032}
    assert got == {r.id: r.score for r in fusion.reciprocal_rank_fusion(b, a).collect()}


def test_merging(spark):
    hits = spark.createDataFrame([("x", "d", "t", 0.1), ("x", "d", "t", 0.9), ("", "d", "u", 0.3), (None, "d", "u", 0.4), ("y", "d", "t", 0.9)], "id string, document_id string, text string, score double")
    assert sorted((r.id or "", r.text, r.score) for r in fusion.keep_best(hits).collect()) == [("", "u", 0.4), ("x", "t", 0.9), ("y", "t", 0.9)]
    assert sorted((r.text, r.score) for r in fusion.first_of_text(hits).collect()) == [("t", 0.9), ("u", 0.4)]


def test_hybrid(spark, chunks):
    q = spark.createDataFrame([(0, "learning", [1.0, 0.0, 0.0])], "query_id long, query string, query_vec array<float>")
    got = retrieval.hybrid_search(chunks, q, 5).orderBy("rank").collect()
    assert {r.id for r in got} == {1, 2}  # the chunk without vector can't be seen


def test_rewrites(spark):
    given = ["细胞的能量工厂是什么", "光合作用的过程", "细胞器的功能", "能量工厂化", "", None, "能量工厂和细胞器"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, q string").select("i", rewrite.rewrites(F.col("q"), most=2).alias("r")).orderBy("i").collect()
    assert [r.r for r in got] == [["细胞的线粒体是什么"], ["光合作用的过程 photosynthesis"], ["线粒体的功能", "叶绿体的功能"], [], [], [], ["线粒体和细胞器", "能量工厂和线粒体"]]
    assert [rule_rewriter(x or "", 2) for x in given] == [r.r for r in got]


def test_quality(spark):
    cases = [([0.95, 0.80], "HIGH"), ([0.02], "LOW"), ([0.30, 0.20], "UNCERTAIN"), ([0.9], "UNCERTAIN")]
    rows = [(i, s, k + 1) for i, (scores, _) in enumerate(cases) for k, s in enumerate(scores)]
    q = spark.createDataFrame([(i,) for i in range(5)], "query_id long")
    got = corrective.judged(spark.createDataFrame(rows, "query_id long, score double, rank long"), q).orderBy("query_id").collect()
    assert [r.quality for r in got] == [*[c for _, c in cases], "LOW"]
    assert [heuristic_evaluator("", [{"score": s} for s in scores]) for scores, _ in cases] == [c for _, c in cases]


def test_fallback_lists(spark):
    hits = spark.createDataFrame([(0, 1, 0.9, 1), (0, 2, 0.8, 2), (1, 3, 0.05, 1)], "query_id long, id long, score double, rank long")
    other = spark.createDataFrame([(0, 7, 1.0), (1, 8, 0.5), (2, 9, 0.5)], "query_id long, id long, score double")
    assert sorted((r.query_id, r.id) for r in retrieval.with_fallback(hits, other).collect()) == [(0, 1), (0, 2), (1, 3), (1, 8), (2, 9)]


def test_keyword_modes(spark, chunks):
    find = lambda q, mode: sorted(r.id for r in listing.keyword_candidates(chunks, q, mode).collect())
    assert find("MACHINE zzz", "any_term") == [1, 3] and find("Machine L", "phrase") == [1] and find("m%e", "raw_like") == [1, 3] and find("m%e", "phrase") == []
    with pytest.raises(ValueError):
        find("x", "other")
    scopes = [retrieval.keyword_search(chunks, "cooking", 5, scope=s).first().score for s in ("candidates", "corpus")]
    assert scopes[0] != scopes[1]
    assert retrieval.keyword_search(chunks, "learning", 1, mode="raw_like").count() == 1


def ids(rows):
    return [r["id"] for r in rows]


def test_pipeline(chunks):
    embed = lambda texts: [[1.0, 0.0, 0.0] for _ in texts]

    def broken(*_):
        raise OSError("no model")

    assert ids(Retriever(chunks, embed).search(" learning "))[0] == 1
    assert set(ids(Retriever(chunks, broken).search("learning"))) == {1, 2}
    assert set(ids(Retriever(chunks).search("learning"))) == {1, 2, 3}
    assert ids(Retriever(chunks, embed).search("learning", SearchOptions(document_id=12))) == []
    assert ids(Retriever(chunks, embed, reranker=lambda q, rows: rows[::-1]).search("learning")) == ids(Retriever(chunks, embed).search("learning"))
    by_id = lambda q, rows: [{**r, "score": float(r["id"])} for r in rows]
    assert ids(Retriever(chunks, embed, reranker=by_id).search("learning")) == [2, 1]
    assert ids(Retriever(chunks, embed, reranker=broken).search("learning"))[0] == 1
    web = lambda q, k: [{"id": "web-0", "document_id": "u", "text": "w", "score": 9.0}]
    assert ids(Retriever(chunks, embed, evaluator=lambda q, r: "LOW", web_search=web).search("learning"))[0] == "web-0"
    assert "web-0" not in ids(Retriever(chunks, embed, evaluator=lambda q, r: "HIGH", web_search=web).search("learning"))
    assert ids(Retriever(chunks, embed, evaluator=lambda q, r: "LOW", web_search=broken).search("learning"))[0] == 1
    more = Retriever(chunks, evaluator=lambda q, r: "UNCERTAIN", rewriter=lambda q, n: ["cooking"] if q == "networks" else [])
    assert set(ids(more.search("networks"))) == {2, 3}
    assert set(ids(Retriever(chunks, rewriter=broken).search("networks"))) == {2}
    assert len(Retriever(chunks).search("learning", SearchOptions(top_k=1))) == 1
    assert SearchOptions(threshold=0.0).settled(Retriever(chunks)).threshold == 0.0 and SearchOptions(top_k=0).settled(Retriever(chunks)).top_k == 5


@pytest.mark.parametrize("most_sent", [vector_search.MOST_SENT, 0])
def test_children_by_tiles(spark, monkeypatch, most_sent):
    monkeypatch.setattr(vector_search, "MOST_SENT", most_sent)
    monkeypatch.setattr(vector_search, "QUERY_STRIP", 1)
    monkeypatch.setattr(vector_search, "VECTOR_STRIP", 1)
    vector = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (F.xxhash64("id", i) % 7).cast("float"))
    odd = F.when(F.col("id") % 97 == 0, F.lit(None)).when(F.col("id") % 89 == 0, F.array().cast("array<float>")).when(F.col("id") % 83 == 0, F.array(F.lit(1.0).cast("float"))).otherwise(vector)
    nodes = spark.range(600).select("id", F.lit(0).alias("document_id"), F.lit(1).alias("layer"), F.col("id").cast("string").alias("text"), odd.alias("embedding"), F.when(F.col("id") % 11 > 0, F.col("id") % 3).alias("parent"))
    asked = nodes.filter("id % 40 = 0 or id in (83, 97)").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    within = asked.select("query_id", F.explode(F.array(F.lit(0), F.col("query_id") % 2 + 1, F.lit(7)).cast("array<bigint>")).alias("id"))
    got = hierarchy._best(nodes, asked, 4, within).select("query_id", "id", "score")
    pairs = nodes.join(within.withColumnRenamed("id", "parent"), "parent").join(asked, "query_id").select("query_id", "id", v.cosine(F.col("embedding"), F.col("query_vec")).alias("score"))
    assert same_hits(got, bm25.ranked(pairs, 4, positive=False).drop("rank")) and got.count() > 40
    # pairs of tiles are rows, pairs of vectors are not
    tiles = vector_search.nearest_within(nodes.withColumnRenamed("parent", "grp"), asked.join(within.withColumnRenamed("id", "grp"), "query_id"), 4)
    assert "MapInArrow" in tiles._jdf.queryExecution().optimizedPlan().toString()


# the inverted index


def same_hits(a, b):
    return sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_index_like_scores_of_all(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    index = KeywordIndex.of(docs, f"{tmp_path}/index")
    asked = docs.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.substring("text", 1, 300).alias("query"))
    asked = asked.unionByName(queries(spark, "the the of and", "zzz", "", "the").withColumn("query_id", F.col("query_id") + 1000))
    for k in (1, 5, 40):
        assert same_hits(index.search(asked, k), bm25.bm25_search(docs, asked, k))
    assert same_hits(index.document_frequencies(), bm25.document_frequencies(bm25.term_frequencies(docs)))
    assert index.statistics().first() == bm25.corpus_statistics(docs).first()
    assert same_hits(index.keyword_search(["the", "of", "the"], 7), retrieval.keyword_search(docs, "the of the", 7))


def test_index_reads_its_terms_only(spark, tmp_path):
    docs = spark.range(3000).select("id", F.concat(F.lit("common word "), F.when(F.col("id") % 500 == 3, "rare rare find").otherwise("plain"), F.lit(" n"), "id").alias("text"))
    docs.write.parquet(f"{tmp_path}/docs")
    index = KeywordIndex.of(spark.read.parquet(f"{tmp_path}/docs"), f"{tmp_path}/index")
    found = index.search(queries(spark, "rare common"), 3)
    assert [(r.id, r.rank) for r in found.orderBy("rank").collect()] == [(3, 1), (503, 2), (1003, 3)]
    plan = index.postings(["rare"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:60] and "EqualTo(term,rare)" in plan
    read = {f.split("bucket=")[1].split("/")[0] for f in index.postings(["rare"]).select(F.input_file_name().alias("f")).distinct().toPandas().f}
    assert len(read) == 1
    # chunks are only ranked that have the term which leads
    terms = bm25.query_terms(queries(spark, "rare common"))
    asked, bounds, _ = index.plan(terms, 3)
    assert {(r.term, r.lead) for r in asked.collect()} == {("rare", True), ("common", False)} and bounds.count() == 1


def test_index_in_segments(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    # texts are dealt out, postings are not
    plan = inverted.postings_of(inverted.in_segments(docs, segment=20_000)).sortWithinPartitions("term")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
    part = inverted.write_part(docs, f"{tmp_path}/index", segment=20_000)
    index = KeywordIndex(spark, f"{tmp_path}/index", [[part]], types=("bigint", "string"))
    segments = -(-docs.agg(F.sum(F.octet_length("text"))).first()[0] // 20_000)
    assert segments > 4 and 4 < index.lengths().select(F.input_file_name()).distinct().count() <= segments
    asked = docs.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.substring("text", 1, 300).alias("query"))
    assert same_hits(index.search(asked, 5), bm25.bm25_search(docs, asked, 5))


@pytest.mark.parametrize("held", [inverted.MOST_HELD, 3000])
def test_postings_are_packed_without_being_rows(spark, tmp_path, monkeypatch, held):
    monkeypatch.setattr(inverted, "MOST_HELD", held)
    monkeypatch.setattr(inverted, "AT_ONCE", 500)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.when(F.col("doc_id") % 9 > 0, F.concat(F.lit("f"), F.col("doc_id") % 5)).alias("document_id"), F.when(F.col("doc_id") % 50 > 0, F.initcap("text")).alias("text"))
    index = KeywordIndex.of(docs, f"{tmp_path}/index")
    assert same_hits(index.postings().select("term", "id", "tf", "dl", "class", "document_id"), inverted.postings_of(docs).select("term", "id", "tf", "dl", "class", "document_id"))
    rows = index._read()
    assert rows.filter("n <> size(ids) or n <> size(tfs) or n <> size(dls) or (term = '') <> (documents is not null)").count() == 0
    # Spark sorts packed rows only: between texts and files no plan makes a row of a posting
    seen, write = [], inverted.mapped
    monkeypatch.setattr(inverted, "mapped", lambda df, run, schema: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, run, schema))
    inverted.write_part(docs, f"{tmp_path}/more")
    assert len(seen) == 1 and "Generate" not in seen[0] and "Sort" not in seen[0]


def test_segments_keep_all_cores_busy(spark):
    docs = spark.range(997).select("id", F.repeat(F.lit("a "), 500).alias("text"))
    cores = spark.sparkContext.defaultParallelism
    assert inverted.in_segments(docs, segment=1000 * 997 // (2 * cores + 1)).rdd.getNumPartitions() == 2 * cores
    assert inverted.in_segments(docs, segment=1000 * 997 // (cores - 1) + 1).rdd.getNumPartitions() == cores - 1


def test_index_is_one_table_of_packed_rows(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    index = KeywordIndex.of(docs, f"{tmp_path}/index")
    assert [p.name for p in (tmp_path / "index").iterdir()] == ["postings"]
    rows, plain = index._read().filter("term <> ''"), bm25.term_frequencies(docs)
    assert rows.agg(F.sum("n"), F.sum(F.size("ids"))).first() == (plain.count(), plain.count())
    assert same_hits(index.postings().filter("term <> ''").select("id", "term", "tf", "dl"), plain)
    bounds = [f(c).alias(f"{c}{i}") for c in ("tf", "dl") for i, f in enumerate((F.max, F.min))]
    told = rows.groupBy("term").agg(F.max("max_tf"), F.min("min_tf"), F.max("max_dl"), F.min("min_dl"))
    assert same_hits(told, plain.groupBy("term").agg(*bounds))
    assert index._read().agg(F.sum("total_dl")).first()[0] == index.lengths().agg(F.sum("dl")).first()[0]


def test_rerank_reads_texts_without_dealing_them_out(spark):
    found = search_queries.rerank(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan and "Repartition" not in plan and "strategy=broadcast" in plan and found.count() == 10


def test_signs_of_every_script_lie_in_the_quick_range(spark):
    signs = spark.range(1, 0x30000).filter("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    assert signs.filter(F.col("c").rlike(text.CJK) & ~F.col("c").rlike(text._MAY_BE_CJK)).count() == 0 and signs.filter(F.col("c").rlike(text.CJK)).count() > 50_000


def test_only_what_is_not_ascii_is_looked_up_for_words(spark):
    plain = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\p{P}\p{S}\p{Z}\x{80}-\x{9F}]+"
    signs = spark.range(1, 0x110000).filter("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    assert signs.filter(F.col("c").rlike(plain) != F.col("c").rlike(text.NOT_WORD)).count() == 0
    odd = spark.createDataFrame([("A b,C", "a b c"), ("Äb É机器X z", "Äb É 机 机器 器 x z"), (None, ""), ("…", "")], "text string, said string")
    words = F.array_join(F.transform(text.tokenize(F.col("text"), lower=False), text.ascii_lower), " ")
    assert odd.filter(~words.eqNullSafe(F.col("said")) | ~F.array_join(text.tokenize(F.col("text")), " ").eqNullSafe(F.col("said"))).count() == 0


def test_index_of_odd_chunks(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "机器学习 machine"), (4, "..."), (5, "machine " * 3000), (6, "Machine")]
    docs = spark.createDataFrame(rows, "id long, text string")
    index = KeywordIndex.of(docs, f"{tmp_path}/index")
    asked = queries(spark, "machine", "机器", "学", "")
    assert same_hits(index.search(asked, 3), bm25.bm25_search(docs, asked, 3)) and index.lengths().count() == 6
    none = KeywordIndex.of(docs.limit(0), f"{tmp_path}/none")
    assert none.search(asked, 3).count() == 0 and none.keyword_search(["machine"], 3).count() == 0
    assert KeywordIndex(spark, f"{tmp_path}/none", [], types=("bigint", "string")).search(asked, 3).count() == 0


def test_retriever_with_an_index(spark, chunks, tmp_path):
    index = KeywordIndex.of(chunks, f"{tmp_path}/index")
    assert Retriever(chunks, index=index).search("learning machine") == Retriever(chunks).search("learning machine")


# filters of files


def files_read(df):
    """What the scan of a plan that has run says."""
    df.collect()
    plan, found = [df._jdf.queryExecution().executedPlan()], []
    while plan:
        node = plan.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            plan.append(node.executedPlan())
        elif node.metrics().contains("numFiles"):
            found.append(node.metrics().apply("numFiles").value())
        plan += [node.children().apply(i) for i in range(node.children().size())]
    return sum(found)


def test_rare_strings_read_few_files(spark, tmp_path):
    words = F.concat_ws(" ", *[F.concat(F.lit("wd"), F.xxhash64("id", F.lit(i)) % 50) for i in range(20)])
    rows = spark.range(0, 4000, 1, 8).select("id", F.when(F.col("id") == 3000, F.concat(words, F.lit(" Zyx-Needle naïve 针"))).otherwise(words).alias("text"))
    rows.write.parquet(f"{tmp_path}/texts")
    texts = spark.read.parquet(f"{tmp_path}/texts")
    write_filters(texts, f"{tmp_path}/filters")
    filters = TextFilters(spark, f"{tmp_path}/filters")
    assert filters.files([]).count() == filters.files(["wd1"]).count() == 8 and filters.files(["zyx-needle"]).count() == 1
    for hit in (filters.containing(texts, "ZYX-needle naï"), filters.like(texts, "needle%针"), filters.like(texts, "Zyx_Needle"), filters.containing(texts, "needle naïve 针")):
        assert files_read(hit) == 1 and [r.id for r in hit.collect()] == [3000]
    none = filters.containing(texts, "nowhere to be found")
    assert none.count() == 0 and files_read(none) == 0
    assert filters.containing(texts, "wd").count() == 4000 and files_read(filters.containing(texts, "wd")) == 8
    # another part comes with its own filters
    spark.createDataFrame([(9999, "a needle again"), (9998, None), (9997, "")], "id long, text string").coalesce(1).write.parquet(f"{tmp_path}/more")
    write_filters(spark.read.parquet(f"{tmp_path}/more"), f"{tmp_path}/filters")
    both = spark.read.parquet(f"{tmp_path}/texts", f"{tmp_path}/more")
    hit = filters.containing(both, "needle")
    assert files_read(hit) == 2 and {r.id for r in hit.collect()} == {3000, 9999}


def test_filters_like_runs_of_each_text(spark, tmp_path):
    spark.createDataFrame([("Needle in a stack",), (None,), ("abc",), ("ABCDabcdabcd",)], "text string").coalesce(1).write.parquet(f"{tmp_path}/texts")
    write_filters(spark.read.parquet(f"{tmp_path}/texts"), f"{tmp_path}/filters", bits=1 << 12)
    (row,) = spark.read.parquet(f"{tmp_path}/filters").collect()
    set_ = {64 * i + b for i, w in enumerate(row.words) for b in range(64) if w >> b & 1}
    runs = {t[i : i + 4].encode() for t in ("needle in a stack", "abcdabcdabcd") for i in range(len(t) - 3)}
    assert len(row.words) == 64 and set_ == {(int.from_bytes(r, "little") * int(m) % (1 << 64) >> 40) % (1 << 12) for r in runs for m in skipping._MULTIPLY}


def test_literals_of_patterns():
    assert literals("abc%de_f") == ["abc", "de", "f"] and literals(r"a\%b") == ["a", "b"] and literals("%_") == [] and literals("abc\\") == ["abc"]
