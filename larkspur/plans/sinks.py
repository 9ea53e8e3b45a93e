"""Results as JSON, text tables and files."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hits_as_json(hits: DataFrame) -> DataFrame:
    """query_id, count, results: each query's hits as a JSON array in order of rank, never null."""
    columns = [c for c in hits.columns if c != "query_id"]
    listed = F.array_sort(F.collect_list(F.struct(*columns)))
    return hits.select("query_id", "rank", *[c for c in columns if c != "rank"]).groupBy("query_id").agg(F.count("*").alias("count"), F.to_json(listed).alias("results"))


def search_json(query: str, rows: list[dict]) -> str:
    """A search's answer as indented JSON."""
    return to_json({"query": query, "count": len(rows), "results": rows})


def documents_json(rows: list[dict], total: int, offset: int) -> str:
    """A page of documents as indented JSON."""
    return to_json({"total": total, "offset": offset, "count": len(rows), "documents": rows})


def to_json(value) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2, default=str)


def shortened(text: str, most: int = 18) -> str:
    """A text for a table: its first octets and "..." if it has more than ``most`` of them; no character is cut."""
    data = text.encode()
    return text if len(data) <= most else data[: most - 3].decode(errors="ignore") + "..."


def masked(secret: str) -> str:
    """A secret for the screen: its ends at most."""
    if not secret:
        return "(not set)"
    return "****" if len(secret) <= 8 else f"{secret[:4]}...{secret[-4:]}"


def duration(seconds: float) -> str:
    """Seconds as 5s, 2m5s or 1h2m."""
    s = int(round(seconds))
    if s < 60:
        return f"{s}s"
    return f"{s // 60}m{s % 60}s" if s < 3600 else f"{s // 3600}h{s % 3600 // 60}m"


def progress(done: int, total: int, seconds: float, failed: int = 0) -> str:
    """How far an ingestion is: chunks done and failed batches, chunks a second, and the time that is left at that rate."""
    rate = done / seconds if seconds > 0 else 0.0
    left = duration((total - done) / rate) if rate else "unknown"
    return f"{done}/{total} chunks, {failed} failed batches, {rate:.1f} chunks/s, {left} left"


def tasks_left(done: int, total: int, seconds: float) -> str:
    """How far the running stages are, and the time that is left at the rate so far."""
    left = duration(seconds / done * (total - done)) if done else "unknown"
    return f"{done}/{total} tasks, {left} left"


class Watch:
    """Says every ``every`` seconds how far the jobs are that run meanwhile, by what Spark tells of its stages."""

    def __init__(self, spark: SparkSession, say: Callable[[str], None], every: float = 5.0):
        self.tracker, self.say, self.every, self.over = spark.sparkContext.statusTracker(), say, every, threading.Event()

    def state(self) -> tuple[int, int]:
        """(tasks that have ended, all tasks) of the running stages."""
        stages = [i for i in map(self.tracker.getStageInfo, self.tracker.getActiveStageIds()) if i]
        return sum(i.numCompletedTasks for i in stages), sum(i.numTasks for i in stages)

    def __enter__(self) -> Watch:
        began = time.monotonic()

        def follow() -> None:
            while not self.over.wait(self.every):
                done, total = self.state()
                if total:
                    self.say(tasks_left(done, total, time.monotonic() - began))

        self.thread = threading.Thread(target=follow, daemon=True)
        self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.over.set()
        self.thread.join()


def text_table(rows: list[dict], columns: dict[str, int]) -> str:
    """Rows as lines of columns of fixed widths."""
    line = lambda cells: "  ".join(str(c).ljust(w) for c, w in zip(cells, columns.values(), strict=True)).rstrip()
    return "\n".join([line(columns), *(line(shortened(str(r.get(c) or ""), w) for c, w in columns.items()) for r in rows)])


def export_text(body: str, path: str) -> None:
    """An entry's body as a file that its owner may write and all may read."""
    Path(path).write_text(body, encoding="utf-8")
    Path(path).chmod(0o644)
