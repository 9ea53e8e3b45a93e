"""Tables of documents, chunks and wiki entries that can be changed, on plain Parquet.

A table is a log of parts: an insert adds a folder of rows, a deletion adds a folder of keys that hide rows of the parts
before it, an update is both. So a change costs what it changes, however long the table; ``compact`` folds a log into one
part, ``vacuum`` deletes what no manifest needs any more. A manifest names every table's log; manifests are numbered, the
last one holds, and a change puts the next one, so readers see all of it or nothing.

There can be several writers. Changes that don't depend on what was read are put after whatever came first; of those that
do (ingestion, updates, deletions by what is found) the later one notices and is made again.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce
from typing import TypeVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.inverted import KeywordIndex, write_part
from larkspur.operators.listing import DocumentQuery, keyword_candidates, list_documents, live_chunks, orphan_chunks
from larkspur.operators.skipping import TextFilters, literals, write_filters
from larkspur.sources.shared import written

SCHEMAS = {
    "documents": "id string, name string, file_path string, doc_type string, content_type string, status string, error string, created_at timestamp, updated_at timestamp",
    "chunks": "id string, document_id string, text string, chunk_index int, embedding array<float>, created_at timestamp",
    "wiki_indexes": "id string, title string, description string, created_at timestamp, updated_at timestamp",
    "wiki_entries": "id string, index_id string, title string, body string, created_at timestamp, updated_at timestamp",
}
INDEXING, INDEXED, FAILED = "indexing", "indexed", "failed"


#: Keys, of all deletions of a table together, up to which they are broadcast to readers; above, the join is left to Spark.
MAX_BROADCAST_KEYS = 200_000
#: Columns that are searched for strings.
SEARCHED = {"chunks": ("text",), "documents": ("name", "file_path")}
#: Entries of a log from which ``compact`` is worth it.
LONG_LOG = 40
ATTEMPTS = 8

T = TypeVar("T")
Log = list[dict]


@dataclass(frozen=True)
class Ingested:
    """What an ingestion has done, as counted by the jobs that wrote it.

    ``failed``: batches of texts that got no vectors; their documents, ``dropped``, are left out with all their chunks.
    """

    documents: int
    chunks: int
    seconds: float
    failed: int = 0
    dropped: int = 0

    @property
    def rate(self) -> float:
        """Chunks a second."""
        return self.chunks / self.seconds if self.seconds > 0 else 0.0


class NotFoundError(LookupError):
    """What was asked for isn't there."""


class ConflictError(RuntimeError):
    """Another writer was first, again and again."""


class Catalog:
    """The tables under one base path.

    ``indexed``: every part of chunks that is added gets its postings beside it, and parts of chunks and documents get the
    filters of their files, by which searches for strings prune.
    """

    def __init__(self, spark: SparkSession, base: str, clock: Callable[[], datetime] = lambda: datetime.now(UTC), indexed: bool = False):
        self.spark, self.base, self.clock, self.closed, self.indexed = spark, base.rstrip("/"), clock, False, indexed
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def close(self) -> None:
        self.closed = True

    # versions

    def _listed(self, name: str = "") -> list:
        return [f.getPath() for f in self._fs.listStatus(self._at(name))] if self._fs.exists(self._at(name)) else []

    def version(self) -> int:
        """The number of the last manifest; 0 where there is none."""
        if self.closed:
            raise RuntimeError("the catalog is closed")
        numbers = [p.getName().removeprefix("manifest-").removesuffix(".json") for p in self._listed()]
        return max((int(n) for n in numbers if n.isdigit()), default=0)

    def _logs(self, version: int) -> dict[str, Log]:
        if not version:
            return {}
        stream = self._fs.open(self._at(f"manifest-{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _written(self, df: DataFrame, name: str) -> str:
        folder = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.base}/{folder}")
        return folder

    def _rows(self, df: DataFrame, name: str) -> dict:
        """An entry that adds rows, and for chunks of an indexed catalog a part of their index; ``rows``: how many it wrote."""
        seen = Observation()
        entry = {"add": self._written(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)}
        entry["rows"] = seen.get["rows"]
        if name == "chunks" and self.indexed:
            entry["terms"] = write_part(self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.base}/{entry['add']}"), f"{self.base}/terms")
        if name in SEARCHED and self.indexed:
            entry["filters"] = f"filters-{uuid.uuid4().hex}"
            write_filters(self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.base}/{entry['add']}"), f"{self.base}/{entry['filters']}", F.concat_ws("\n", *SEARCHED[name]))
        return entry

    def _keys(self, keys: DataFrame | list, name: str, column: str = "id") -> dict:
        """An entry that hides the rows of these keys (of a list, or the only column of a table)."""
        if not isinstance(keys, DataFrame):
            keys = self.spark.createDataFrame([(k,) for k in keys], f"{column} string")
        folder = self._written(keys.toDF(column).distinct(), name)
        return {"hide": folder, "by": column, "keys": self.spark.read.parquet(f"{self.base}/{folder}").count()}

    def _commit(self, entries: dict[str, Log], seen: int | None = None) -> None:
        """Put entries behind the tables' logs. ``seen``: the version that they depend on; any other one is a conflict."""
        for _ in range(ATTEMPTS):
            version = self.version()
            if seen is not None and version != seen:
                break
            logs = self._logs(version)
            if self._put(version + 1, {**logs, **{name: logs.get(name, []) + log for name, log in entries.items()}}):
                return
        raise ConflictError(f"version {seen or self.version()} isn't the last one any more")

    def _put(self, version: int, logs: dict[str, Log]) -> bool:
        """Whether this manifest came to be the one of that number."""
        jvm, new = self.spark._jvm, self._at(f"manifest-{uuid.uuid4().hex}.json")
        stream = self._fs.create(new, True)
        stream.write(bytearray(json.dumps(logs).encode()))
        stream.close()
        to = self._at(f"manifest-{version:012d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(new, to, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            self._fs.delete(new, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def _again(self, change: Callable[[int], T]) -> T:
        """``change(version)`` that depends on that version, until no other writer comes between."""
        for _ in range(ATTEMPTS):
            try:
                return change(self.version())
            except ConflictError:
                continue
        raise ConflictError("other writers were always first")

    def compact(self, *names: str) -> None:
        """One part for each of the tables (all whose log is long, if none is named)."""

        def change(seen: int) -> None:
            logs = self._logs(seen)
            some = [n for n in names or logs if n in logs and len(logs[n]) > (1 if names else LONG_LOG)]
            if some and not self._put(seen + 1, logs | {n: [self._rows(self.table(n, seen), n)] for n in some}):
                raise ConflictError(f"version {seen} isn't the last one any more")

        self._again(change)

    def vacuum(self) -> int:
        """Delete parts and manifests that the last manifest doesn't name; their number. For when nobody reads or writes."""
        version = self.version()
        named = {x for log in self._logs(version).values() for e in log for x in (e.get("add"), e.get("hide"), e.get("filters"))} | {f"manifest-{version:012d}.json"}
        old = [p for p in self._listed() if p.getName() not in named and p.getName().partition("-")[0] in (*SCHEMAS, "manifest", "filters")]
        indexed = {f"part={e['terms']}" for log in self._logs(version).values() for e in log if "terms" in e}
        for kind in ("postings", "blocks"):
            old += [p for p in self._listed(f"terms/{kind}") if p.getName() not in indexed]
        for p in old:
            self._fs.delete(p, True)
        return len(old)

    def _parts(self, log: Log, kind: str = "add") -> tuple[list[list[str]], dict[str, DataFrame], int]:
        """(parts by generation, by column the keys (key, until) that hide rows of generations before ``until``, all keys' number).

        A deletion begins a new generation, so a log of any number of them is joined once for each kind of key.
        """
        generations: list[list[str]] = [[]]
        hidden: dict[str, list[DataFrame]] = {}
        for entry in log:
            if kind in entry:
                generations[-1].append(entry[kind])
            elif entry.get("keys"):
                key = self.spark.read.schema(f"{entry['by']} string").parquet(f"{self.base}/{entry['hide']}").toDF("__key")
                hidden.setdefault(entry["by"], []).append(key.withColumn("__until", F.lit(len(generations))))
                generations.append([])
        last = {by: reduce(DataFrame.unionByName, keys).groupBy("__key").agg(F.max("__until").alias("__until")) for by, keys in hidden.items()}
        return generations, last, sum(entry.get("keys", 0) for entry in log)

    def table(self, name: str, version: int | None = None, holding: list[str] | None = None) -> DataFrame:
        """A table as it is now, or was at a version; of an indexed one the files that may hold all of some strings.

        ``holding`` prunes, it doesn't filter; parts without filters are read whole.
        """
        log = self._logs(self.version() if version is None else version).get(name, [])
        generations, hidden, n = self._parts(log)
        filters = {e["add"]: f"{self.base}/{e['filters']}" for e in log if "filters" in e}
        may = F.lit(True)
        if holding and filters:
            # names of files that filters speak of and that they leave; as many as parts have files
            known = TextFilters(self.spark, *filters.values())
            left, told = {r.file for r in known.files(holding).collect()}, {r.file for r in known.files([]).collect()}
            may = ~F.col("_metadata.file_path").isin(*sorted(told - left)) if told - left else may
        parts = [self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.base}/{f}" for f in folders]).filter(may).withColumn("__generation", F.lit(g)) for g, folders in enumerate(generations) if folders]
        if not parts:
            return self.spark.createDataFrame([], SCHEMAS[name])
        out = reduce(DataFrame.unionByName, parts)
        for by, keys in hidden.items():
            gone = (F.col(by) == F.col("__key")) & (F.col("__generation") < F.col("__until"))
            out = out.join(F.broadcast(keys) if n <= MAX_BROADCAST_KEYS else keys, gone, "left_anti")
        return out.drop("__generation")

    def has_index(self) -> bool:
        """Whether every part of the chunks has its part of the index."""
        return all("terms" in e for e in self._logs(self.version()).get("chunks", []) if "add" in e)

    def keyword_index(self) -> KeywordIndex:
        """The index of the chunks as they are now, of the parts that ingestion has written; texts aren't read."""
        log = self._logs(self.version()).get("chunks", [])
        if not self.has_index():
            raise ValueError("chunks were added without an index; compact them with indexed=True")
        generations, hidden, _ = self._parts(log, "terms")
        index = KeywordIndex(self.spark, f"{self.base}/terms", generations)
        if not hidden:
            return index
        rows = index.lengths(generation=True)
        gone = [rows.join(keys, (F.col(by) == F.col("__key")) & (F.col("generation") < F.col("__until")), "left_semi").select("generation", "id") for by, keys in hidden.items()]
        return KeywordIndex(self.spark, f"{self.base}/terms", generations, written(reduce(DataFrame.unionByName, gone).distinct(), "gone"))

    def _updated(self, name: str, changes: DataFrame) -> None:
        """Rows of the ids of ``changes`` get its other columns; ids that aren't there don't matter."""

        def change(seen: int) -> None:
            own, rows = [c for c in changes.columns if c != "id"], self.table(name, seen)
            new = rows.drop(*own).join(changes, "id").withColumn("updated_at", F.lit(self.clock())).select(*rows.columns)
            added = self._rows(new, name)
            there = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.base}/{added['add']}").select("id")
            if not there.isEmpty():
                self._commit({name: [self._keys(there, name), added]}, seen)

        self._again(change)

    def _shaped(self, rows: DataFrame | list[dict], name: str) -> DataFrame:
        """Rows in a table's columns; those that are missing are null, ids and times that are null are made."""
        if not isinstance(rows, DataFrame):
            fields = [c.split()[0] for c in SCHEMAS[name].split(", ")]
            rows = self.spark.createDataFrame([tuple(r.get(c) for c in fields) for r in rows], SCHEMAS[name])
        now = F.lit(self.clock())
        kinds = {c.split()[0]: c.split()[1] for c in SCHEMAS[name].split(", ")}
        out = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
        return out.withColumns({c: now for c in kinds if c in ("created_at", "updated_at")})

    # documents

    def add_documents(self, rows: DataFrame | list[dict]) -> None:
        new = self._shaped(rows, "documents")
        self._commit({"documents": [self._rows(new.withColumn("id", F.coalesce("id", F.sha2(F.concat_ws("|", "file_path", "name"), 256))), "documents")]})

    def set_status(self, document_id: str, status: str, error: str | None = None) -> None:
        """Of an unknown document nothing changes."""
        self.set_statuses(self.spark.createDataFrame([(document_id, status, error)], "id string, status string, error string"))

    def set_statuses(self, changes: DataFrame) -> None:
        """The statuses and errors of many documents (id, status, error) as one change."""
        self._updated("documents", changes.select("id", "status", "error"))

    def document(self, document_id: str):
        return self.table("documents").filter(F.col("id") == document_id).first()

    def documents_at(self, path: str) -> DataFrame:
        """Documents of exactly this path, newest first."""
        return self.table("documents").filter(F.col("file_path") == path).orderBy(F.desc("created_at"), F.desc("id"))

    def delete_documents(self, ids: list[str] | DataFrame, cascade: bool = True) -> int:
        """Delete documents and their chunks; the number of chunks that went. Unknown ids don't matter.

        Without ``cascade`` chunks stay, as orphans.
        """
        if not isinstance(ids, DataFrame):
            if not ids:
                return 0
            ids = self.spark.createDataFrame([(i,) for i in ids], "id string")

        def change(seen: int) -> int:
            by_id = self._keys(ids, "documents")
            if not cascade:
                self._commit({"documents": [by_id]}, seen)
                return 0
            keys = self.spark.read.parquet(f"{self.base}/{by_id['hide']}")
            gone = self.table("chunks", seen).join(keys.withColumnRenamed("id", "document_id"), "document_id", "left_semi").count()
            self._commit({"documents": [by_id], "chunks": [self._keys(keys, "chunks", "document_id")]}, seen)
            return gone

        return self._again(change)

    def delete_document(self, document_id: str) -> int:
        return self.delete_documents([document_id])

    def delete_checked(self, document_id: str) -> int:
        """Like delete_document, but an unknown id is an error, before anything is deleted."""
        if self.document(document_id) is None:
            raise NotFoundError(f"no document {document_id}")
        return self.delete_document(document_id)

    # chunks

    def add_chunks(self, rows: DataFrame | list[dict]) -> None:
        """All chunks or none; their documents must exist. An empty vector is no vector."""
        new = self._shaped(rows, "chunks").withColumn("id", F.coalesce("id", F.sha2(F.concat_ws("|", "document_id", "chunk_index"), 256)))
        new = new.withColumn("embedding", F.when(F.size("embedding") > 0, F.col("embedding")))
        if new.isEmpty():
            return
        if not new.join(self.table("documents").select(F.col("id").alias("document_id")), "document_id", "left_anti").isEmpty():
            raise ValueError("a chunk's document doesn't exist")
        self._commit({"chunks": [self._rows(new, "chunks")]})

    def live_chunks(self) -> DataFrame:
        return live_chunks(self.table("chunks"), self.table("documents"))

    def chunks_containing(self, string: str) -> DataFrame:
        """Chunks whose text holds the string, ASCII case aside."""
        return keyword_candidates(self.table("chunks", holding=[string]), string, "phrase")

    def chunks_like(self, pattern: str) -> DataFrame:
        """Chunks whose text matches the LIKE pattern somewhere, ASCII case aside."""
        return keyword_candidates(self.table("chunks", holding=literals(pattern)), pattern, "raw_like")

    def list_documents(self, query: DocumentQuery = DocumentQuery()) -> DataFrame:
        """The page asked for; what is searched for prunes files first."""
        return list_documents(self.table("documents", holding=[query.search.strip()] if query.search.strip() else None), query)

    def count_orphans(self) -> int:
        return orphan_chunks(self.table("chunks"), self.table("documents")).count()

    def delete_orphans(self) -> int:
        """Delete chunks whose document is gone; their number."""

        def change(seen: int) -> int:
            lost = orphan_chunks(self.table("chunks", seen), self.table("documents", seen))
            n = lost.count()
            if n:
                self._commit({"chunks": [self._keys(lost.select("document_id"), "chunks", "document_id")]}, seen)
            return n

        return self._again(change)

    # ingestion

    def ingest(self, documents: DataFrame, chunks: DataFrame, force: bool = False, keyword_only: bool = False) -> int:
        """How many documents ingest_measured() has added."""
        return self.ingest_measured(documents, chunks, force, keyword_only).documents

    def ingest_measured(self, documents: DataFrame, chunks: DataFrame, force: bool = False, keyword_only: bool = False) -> Ingested:
        """Documents with their chunks as one change, indexed; documents of a path that is there already are skipped.

        ``force``: they replace all of that path instead. ``keyword_only``: chunks get no vectors. If anything fails,
        nothing has changed. Chunks of embed_chunks(tolerant=True) may come without vector: their documents are left out.
        All counts are observed in the jobs that write; nothing is read again for them.
        """
        asked = self._shaped(documents, "documents")
        asked = asked.withColumn("id", F.coalesce("id", F.sha2(F.concat_ws("|", "file_path", "name"), 256))).withColumn("status", F.lit(INDEXED))
        parts = self._shaped(chunks, "chunks").withColumn("id", F.coalesce("id", F.sha2(F.concat_ws("|", "document_id", "chunk_index"), 256)))
        if keyword_only:
            parts = parts.withColumn("embedding", F.lit(None).cast("array<float>"))

        began, failed, lost = time.monotonic(), 0, None
        if "error" in chunks.columns:
            # what came without vector is known once all chunks are there: a table, so that texts are sent once
            told = Observation()
            marked = chunks.observe(told, F.sum(F.col("batch_failed").cast("long")).alias("failed"))
            staged = written(marked, "staged")
            failed, parts = told.get["failed"] or 0, self._shaped(staged.drop("error", "batch_failed"), "chunks")
            parts = parts.withColumn("id", F.coalesce("id", F.sha2(F.concat_ws("|", "document_id", "chunk_index"), 256)))
            lost = staged.filter(F.col("error").isNotNull()).select(F.col("document_id").cast("string").alias("id")).distinct()

        def change(seen: int) -> Ingested:
            old = self.table("documents", seen)
            new = asked if force else asked.join(old.select("file_path").distinct(), "file_path", "left_anti").select(*old.columns)
            dropped = 0
            if failed:
                dropped = new.join(lost, "id", "left_semi").count()
                new = new.join(lost, "id", "left_anti")
            added = self._rows(new, "documents")
            n = added["rows"]
            if not n:
                return Ingested(0, 0, time.monotonic() - began, failed, dropped)
            new = self.spark.read.schema(SCHEMAS["documents"]).parquet(f"{self.base}/{added['add']}")
            logs: dict[str, Log] = {"documents": [added], "chunks": [self._rows(parts.join(new.select(F.col("id").alias("document_id")), "document_id", "left_semi").select(*parts.columns), "chunks")]}
            n_chunks = logs["chunks"][0]["rows"]
            if force:
                replaced = old.join(new.select("file_path").distinct(), "file_path", "left_semi").select("id")
                hidden = self._keys(replaced, "documents")
                keys = self.spark.read.parquet(f"{self.base}/{hidden['hide']}")
                logs = {"documents": [hidden, added], "chunks": [self._keys(keys, "chunks", "document_id"), *logs["chunks"]]}
            self._commit(logs, seen)
            return Ingested(n, n_chunks, time.monotonic() - began, failed, dropped)

        return self._again(change)

    # wiki

    def add_index(self, title: str, description: str = "", index_id: str | None = None) -> str:
        index_id = index_id or uuid.uuid4().hex
        self.add_indexes([{"id": index_id, "title": title, "description": description}])
        return index_id

    def add_indexes(self, rows: DataFrame | list[dict]) -> None:
        self._commit({"wiki_indexes": [self._rows(self._shaped(rows, "wiki_indexes"), "wiki_indexes")]})

    def index(self, index_id: str):
        return self.table("wiki_indexes").filter(F.col("id") == index_id).first()

    def indexes(self) -> DataFrame:
        return self.table("wiki_indexes").orderBy("title", "id")

    def delete_index(self, index_id: str) -> None:
        """Delete an index and its entries."""
        self._commit({"wiki_entries": [self._keys([index_id], "wiki_entries", "index_id")], "wiki_indexes": [self._keys([index_id], "wiki_indexes")]})

    def add_entry(self, index_id: str, title: str, body: str, entry_id: str | None = None) -> str:
        entry_id = entry_id or uuid.uuid4().hex
        self.add_entries([{"id": entry_id, "index_id": index_id, "title": title, "body": body}])
        return entry_id

    def add_entries(self, rows: DataFrame | list[dict]) -> None:
        """All entries or none; their indexes must exist."""
        new = self._shaped(rows, "wiki_entries")
        lost = new.join(self.table("wiki_indexes").select(F.col("id").alias("index_id")), "index_id", "left_anti").select("index_id").first()
        if lost is not None:
            raise NotFoundError(f"no index {lost.index_id}")
        self._commit({"wiki_entries": [self._rows(new, "wiki_entries")]})

    def entry(self, entry_id: str):
        return self.table("wiki_entries").filter(F.col("id") == entry_id).first()

    def entries(self, index_id: str) -> DataFrame:
        """An index's entries, newest first."""
        if self.index(index_id) is None:
            raise NotFoundError(f"no index {index_id}")
        return self.all_entries().filter(F.col("index_id") == index_id)

    def all_entries(self) -> DataFrame:
        """Every index's entries, newest first."""
        return self.table("wiki_entries").join(self.table("wiki_indexes").select(F.col("id").alias("index_id")), "index_id", "left_semi").orderBy("index_id", F.desc("created_at"), F.desc("id"))

    def update_entry(self, entry_id: str, title: str, body: str) -> None:
        """Of an unknown entry nothing changes; an id must be given."""
        if not entry_id:
            raise ValueError("an entry's id is needed")
        self._updated("wiki_entries", self.spark.createDataFrame([(entry_id, title, body)], "id string, title string, body string"))

    def delete_entry(self, entry_id: str) -> None:
        self._commit({"wiki_entries": [self._keys([entry_id], "wiki_entries")]})
