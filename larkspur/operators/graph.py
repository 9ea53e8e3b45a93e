"""A knowledge graph as two tables: entities (id, name, type, ...) and relations (id, source, target, type, ...)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import unfenced
from larkspur.operators import matching
from larkspur.operators.bounded import sent
from larkspur.sources.models import ask
from larkspur.sources.shared import delete, run_dir, written

#: Neighbours of an entity in one row of an adjacency table, about.
HUB = 10_000

#: What a model is asked to answer with.
ANSWER = "entities array<struct<id:string,name:string,type:string,description:string,properties:map<string,string>>>, relations array<struct<id:string,source:string,target:string,type:string,description:string,properties:map<string,string>>>"


def last_of(rows: DataFrame, order: str, key: str = "id") -> DataFrame:
    """Of rows with one key that of the greatest ``order``."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("__r")).select("__r.*")


def checked_relations(relations: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations whose ends both exist, the others)."""
    ids = entities.select(F.col("id").alias("__e"))
    good = relations.join(ids, relations["source"] == ids["__e"], "left_semi").join(ids, F.col("target") == ids["__e"], "left_semi")
    return good, relations.join(good.select("id"), "id", "left_anti")


def parsed_answers(answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, bad answers) of a model's answers (document_id, seq, answer), which may be fenced JSON.

    The last entity or relation of an id stays, tagged with its document; relations need both ends.
    """
    read = answers.withColumn("__j", F.from_json(unfenced(F.col("answer")), ANSWER))
    bad = read.filter(F.col("__j").isNull() | (F.col("__j.entities").isNull() & F.col("__j.relations").isNull())).drop("__j")

    def rows(part: str) -> DataFrame:
        each = read.select("document_id", "seq", F.posexplode(f"__j.{part}").alias("__n", "r")).select("r.*", "document_id", F.struct("seq", "__n").alias("__o"))
        tag = F.map_from_arrays(F.array(F.lit("document_id")), F.array(F.col("document_id").cast("string")))
        old = F.map_filter(F.coalesce("properties", F.create_map().cast("map<string,string>")), lambda k, _: k != "document_id")
        return last_of(each.withColumn("properties", F.map_concat(old, tag)), "__o").drop("__o", "document_id")

    entities = rows("entities").filter(F.col("id").isNotNull())
    return entities, checked_relations(rows("relations"), entities)[0], bad


def build_graph(chunks: DataFrame, complete: Callable[[str], str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, bad answers) that a model finds in chunks (document_id, chunk_index, text).

    Every chunk is asked about once, by the tasks that hold them; the answers are a table, from which all three come. Of
    chunks without usable answer the document and what went wrong stay, the others go on.
    """
    order = F.struct(F.col("document_id").cast("string"), F.col("chunk_index").cast("long"))
    asked = chunks.select("document_id", order.alias("seq"), entity_prompt(F.col("document_id").cast("string"), F.col("text")).alias("prompt"))
    return parsed_answers(written(ask(asked, complete).drop("prompt"), "answers"))


def names_asked(queries: DataFrame, complete: Callable[[str], str]) -> DataFrame:
    """query_id, name: the entities that a model finds named in each query (query_id, query); none where its answer is no list."""
    asked = queries.select("query_id", name_prompt(F.col("query")).alias("prompt"))
    answers = written(ask(asked, complete).select("query_id", "answer"), "names")
    return answers.select("query_id", F.explode(F.from_json(unfenced(F.col("answer")), "array<string>")).alias("name")).filter(F.trim("name") != "").distinct()


def find_entities(entities: DataFrame, name: str) -> DataFrame:
    """Entities whose name contains ``name``, whatever the case."""
    return entities.filter(F.contains(F.lower("name"), F.lit(name.lower())))


def link_entities(entities: DataFrame, names: DataFrame) -> DataFrame:
    """query_id, id: entities whose name contains one of a query's names (query_id, name), ASCII or not, whatever the case.

    Every entity's name runs once through an automaton of the distinct names (of each block of them).
    """
    wanted = names.select("query_id", F.lower("name").alias("phrase")).filter(F.col("phrase") != "")
    found = matching.phrases_in(entities.select("id", F.lower("name").alias("text")), wanted)
    return found.join(wanted, "phrase").select("query_id", "id").distinct()


def outgoing(relations: DataFrame, entity_id: str) -> DataFrame:
    return relations.filter(F.col("source") == entity_id)


def incoming(relations: DataFrame, entity_id: str) -> DataFrame:
    return relations.filter(F.col("target") == entity_id)


def neighbours(relations: DataFrame) -> DataFrame:
    """id, other, relation_id: both directions of every relation."""
    forth = relations.select(F.col("source").alias("id"), F.col("target").alias("other"), F.col("id").alias("relation_id"))
    return forth.unionByName(forth.select(F.col("other").alias("id"), F.col("id").alias("other"), "relation_id"))


class Adjacency:
    """Both directions of relations as a table that is written once: id, others (an array), in buckets by id.

    Hops join what they have reached with it, which is all that is shuffled. An entity of more than ``hub`` neighbours has as
    many rows as it takes to keep each to about ``hub`` of them, so none is one task's.
    """

    def __init__(self, relations: DataFrame, hub: int = HUB):
        self.spark = relations.sparkSession
        edges = neighbours(relations).select("id", "other").filter(F.col("id").isNotNull() & F.col("other").isNotNull())
        hubs = edges.groupBy("id").agg(F.count("*").alias("__n")).filter(F.col("__n") > hub)
        salt = F.pmod(F.xxhash64("other"), F.coalesce(F.ceil(F.col("__n") / hub), F.lit(1)))
        rows = edges.join(sent(hubs), "id", "left").groupBy("id", salt.alias("salt")).agg(F.collect_set("other").alias("others"))
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, self.path = f"larkspur_adjacency_{uuid.uuid4().hex}", f"{run_dir(self.spark)}/adjacency-{uuid.uuid4().hex}"
        rows.select("id", "others").repartition(buckets, "id").write.bucketBy(buckets, "id").sortBy("id").option("path", self.path).saveAsTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def step(self, frontier: DataFrame) -> DataFrame:
        """query_id, id of what is one relation away from the frontier's (query_id, id), with repeats."""
        # a small frontier is sent to the table's readers; a large one is dealt out by id, as the table is already
        return self.table().join(sent(frontier), "id").select("query_id", F.explode("others").alias("id"))

    def drop(self) -> None:
        """The table goes; what was reached is in tables of its own."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)


def reached(relations: DataFrame, seeds: DataFrame, hops: int = 2, hub: int = HUB) -> DataFrame:
    """query_id, id, hops: entities at most ``hops`` (0 and less: 2) relations from a query's seeds (query_id, id).

    Each round joins only what the last one found, and is a table of its own, so plans don't grow with the rounds.
    """
    hops = hops if hops > 0 else 2
    edges = Adjacency(relations, hub)
    seen = frontier = written(seeds.select("query_id", "id").distinct().withColumn("hops", F.lit(0)), "seeds")
    for h in range(1, hops + 1):
        new = edges.step(frontier).distinct()
        frontier = written(new.join(seen.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("hops", F.lit(h)), f"hop{h}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    edges.drop()
    return seen


def subgraph(entities: DataFrame, relations: DataFrame, seeds: DataFrame, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """(entities with query_id and hops, relations with query_id) around seeds.

    Relations of entities less than ``hops`` away lead to what is reached; those of entities ``hops`` away are part of
    it too, though their far ends need not be.
    """
    near = reached(relations, seeds.join(entities.select("id"), "id", "left_semi"), hops)
    touched = near.join(neighbours(relations).select("id", "relation_id"), "id").select("query_id", "relation_id").distinct()
    return near.join(entities, "id"), touched.join(relations.withColumnRenamed("id", "relation_id"), "relation_id").withColumnRenamed("relation_id", "id")


def search_graph(entities: DataFrame, relations: DataFrame, names: DataFrame, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """The subgraphs around the entities that a query's names link to; nothing where none does."""
    return subgraph(entities, relations, link_entities(entities, names), hops)


def ask_graph(entities: DataFrame, relations: DataFrame, queries: DataFrame, complete: Callable[[str], str], hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """search_graph() of questions (query_id, query), whose names a model finds."""
    return search_graph(entities, relations, names_asked(queries, complete), hops)


def entity_prompt(document_id: Column, text: Column) -> Column:
    """What a model is asked of a chunk: one JSON object."""
    shape = (
        '{"entities": [{"id": ..., "name": ..., "type": "person, organization, concept ...", "description": ...}],'
        ' "relations": [{"id": ..., "source": "an entity\'s id", "target": "an entity\'s id", "type": "is_a, part_of, relates_to ...", "description": ...}]}'
    )
    told = F.concat(F.lit("List the key entities of the text below and how they relate, as JSON of this form:\n" + shape + "\nUse ids of the form doc_"), document_id, F.lit("_entity_N and doc_"), document_id)
    return F.concat(told, F.lit("_rel_N, each for one thing.\n\nText:\n"), text)


def name_prompt(query: Column) -> Column:
    """What a model is asked of a question: a JSON array of names."""
    return F.concat(F.lit('Which entities does this question name? Answer with a JSON array of their names alone, like ["one", "another"].\n\nQuestion: '), query)
