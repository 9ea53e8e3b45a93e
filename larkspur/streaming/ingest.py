"""Files that keep arriving, parsed and chunked into a catalog as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from larkspur.functions.chunking import ChunkOptions, chunk_documents
from larkspur.sources.catalog import Catalog, Ingested
from larkspur.sources.parsers import OK, parse_files
from larkspur.sources.shared import discard, written

FILES = "path string, modificationTime timestamp, length long, content binary"


def as_documents(parsed: DataFrame) -> DataFrame:
    """id, name, file_path, doc_type, text of parsed files that could be read; the id is a hash of the path."""
    return parsed.filter((F.col("status") == OK) & (F.col("text") != "")).select(
        F.sha2("path", 256).alias("id"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("path").alias("file_path"), F.col("file_type").alias("doc_type"), "text"
    )


def ingest_files(catalog: Catalog, files: DataFrame, options: ChunkOptions = ChunkOptions(), force: bool = False) -> Ingested:
    """Files (path, content) as documents and chunks for keyword search, one change of the catalog; what it did."""
    # parsed once, though documents and chunks are made of it
    docs = written(as_documents(parse_files(files)).dropDuplicates(["id"]), "parsed")
    done = catalog.ingest_measured(docs, chunk_documents(docs, options), force=force, keyword_only=True)
    discard(docs)
    return done


class Batches(StreamingQueryListener):
    """What a stream has done: its micro-batches' numbers, rows read and seconds, and how it ended."""

    def __init__(self) -> None:
        self.batches: list[tuple[int, int, float]] = []
        self.error: str | None = None

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.numInputRows:
            self.batches.append((p.batchId, p.numInputRows, (p.durationMs.get("triggerExecution") or 0) / 1000))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.error = event.exception


def follow_folder(spark: SparkSession, folder: str, catalog: Catalog, checkpoint: str, options: ChunkOptions = ChunkOptions(), force: bool = False, told: Callable[[int, Ingested], None] | None = None) -> StreamingQuery:
    """A stream that ingests what a folder gets. A batch that runs again after a failure changes nothing: its paths are there.

    ``told``: is told of each micro-batch what it did (number, Ingested).
    """
    stream = spark.readStream.format("binaryFile").schema(FILES).load(folder)

    def take(batch: DataFrame, number: int) -> None:
        done = ingest_files(catalog, batch.select("path", "content"), options, force)
        if told:
            told(number, done)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
