"""Commands: init, config, add, search, list, delete, gc, get-chunk, wiki."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from larkspur.functions.chunking import ChunkOptions, chunk_documents
from larkspur.operators import listing
from larkspur.operators.listing import DocumentQuery, page_offset, parse_filters
from larkspur.operators.retrieval import Retriever, SearchOptions
from larkspur.plans import config as settings
from larkspur.plans import sinks
from larkspur.sources.catalog import Catalog, NotFoundError
from larkspur.sources.shared import discard, written
from larkspur.sources.models import HttpEmbedder, HttpEvaluator, HttpReranker, HttpRewriter, HttpWebSearch, embed_chunks, heuristic_evaluator, rule_rewriter
from larkspur.sources.parsers import OK, read_files
from larkspur.streaming.ingest import as_documents


def body_of(args: argparse.Namespace) -> str:
    """An entry's body from --body or --file, one of them, trimmed and not empty."""
    if (args.body is None) == (args.file is None):
        raise ValueError("give either --body or --file")
    body = (args.body if args.file is None else Path(args.file).read_text(encoding="utf-8")).strip()
    if not body:
        raise ValueError("the body is empty")
    return body


def retriever_of(config: settings.Config, catalog: Catalog) -> Retriever:
    """A retriever with the models that the settings name."""
    e, r, c, q = config.embedding, config.reranker, config.corrective, config.query_rewrite
    retriever = Retriever(catalog.live_chunks(), rewrite_limit=q.max_queries)
    if e.api_key:
        retriever.embed = HttpEmbedder(e.url, e.model, e.api_key, e.max_batch)
    elif catalog.has_index():
        retriever.index = catalog.keyword_index()
    if r.enabled and r.url:
        retriever.reranker = HttpReranker(r.url, r.model, r.api_key)
    if q.enabled:
        retriever.rewriter = HttpRewriter(q.url, q.model, q.api_key) if q.url else rule_rewriter
    if c.enabled:
        retriever.evaluator = HttpEvaluator(c.evaluator_url, c.model, c.api_key) if c.evaluator_url else heuristic_evaluator
        retriever.web_search = HttpWebSearch(c.web_search_url, c.api_key) if c.web_search_url else None
    return retriever


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="larkspur")
    p.add_argument("--config", type=Path)
    verbs = p.add_subparsers(dest="verb", required=True)
    verbs.add_parser("init")
    c = verbs.add_parser("config")
    c.add_argument("action", choices=["get", "set", "list"])
    c.add_argument("key", nargs="?")
    c.add_argument("value", nargs="?")
    a = verbs.add_parser("add")
    a.add_argument("path")
    a.add_argument("--chunk-size", type=int)
    a.add_argument("--overlap", type=int)
    a.add_argument("--force", action="store_true")
    s = verbs.add_parser("search")
    s.add_argument("query")
    s.add_argument("--top-k", type=int, default=5)
    s.add_argument("--threshold", type=float)
    s.add_argument("--document")
    s.add_argument("--json", action="store_true")
    ls = verbs.add_parser("list")
    ls.add_argument("--search", default="")
    ls.add_argument("--filter", action="append", default=[])
    for name in ("--limit", "--offset", "--page"):
        ls.add_argument(name, type=int, default=0)
    ls.add_argument("--json", action="store_true")
    verbs.add_parser("delete").add_argument("id")
    verbs.add_parser("gc").add_argument("--dry-run", action="store_true")
    g = verbs.add_parser("get-chunk")
    g.add_argument("document")
    g.add_argument("index", type=int)
    wiki = verbs.add_parser("wiki").add_subparsers(dest="wiki", required=True)
    wiki.add_parser("index-list")
    i = wiki.add_parser("index-create")
    i.add_argument("title")
    i.add_argument("--description", default="")
    wiki.add_parser("index-delete").add_argument("id")
    r = wiki.add_parser("remember")
    r.add_argument("index")
    r.add_argument("title")
    u = wiki.add_parser("update")
    u.add_argument("id")
    u.add_argument("--title")
    for x in (r, u):
        x.add_argument("--body")
        x.add_argument("--file")
    wiki.add_parser("list").add_argument("index")
    wiki.add_parser("get").add_argument("id")
    e = wiki.add_parser("export")
    e.add_argument("id")
    e.add_argument("file")
    wiki.add_parser("forget").add_argument("id")
    return p


def run(argv: list[str], spark: SparkSession | None = None) -> str:
    """What a command prints."""
    args = parser().parse_args(argv)
    config = settings.load(args.config)
    if args.verb == "init":
        settings.save(config, args.config)
        return "saved"
    if args.verb == "config":
        if args.action == "list":
            return "\n".join(f"{k} = {config.display(k)}" for k in config.keys())
        if args.action == "get":
            return config.display(args.key)
        config.set(args.key, args.value)
        settings.save(config, args.config)
        return f"{args.key} = {config.display(args.key)}"
    catalog = Catalog(spark or SparkSession.builder.getOrCreate(), config.storage.path, indexed=True)
    return wiki(args, catalog) if args.verb == "wiki" else COMMANDS[args.verb](args, catalog, config)


def add(args, catalog: Catalog, config: settings.Config) -> str:
    options = ChunkOptions(args.chunk_size or config.chunking.max_tokens, config.chunking.overlap if args.overlap is None else args.overlap)
    parsed = written(read_files(catalog.spark, args.path), "parsed")
    bad = [f"{r.path}: {r.status}: {r.error}" for r in parsed.filter(F.col("status") != OK).select("path", "status", "error").limit(20).collect()]
    docs = as_documents(parsed)
    chunks = chunk_documents(docs, options)
    e = config.embedding
    if e.api_key:
        chunks = embed_chunks(chunks, HttpEmbedder(e.url, e.model, e.api_key, e.max_batch), tolerant=True)
    with sinks.Watch(catalog.spark, lambda line: print(line, file=sys.stderr)):
        done = catalog.ingest_measured(docs, chunks, force=args.force, keyword_only=not e.api_key)
    discard(parsed)
    lost = [f"{done.dropped} documents left out, whose texts got no vectors"] if done.dropped else []
    return "\n".join([f"{done.documents} documents added", sinks.progress(done.chunks, done.chunks, done.seconds, done.failed), *lost, *bad])


def search(args, catalog: Catalog, config: settings.Config) -> str:
    rows = retriever_of(config, catalog).search(args.query, SearchOptions(args.top_k, args.threshold, args.document))
    names = {r.id: r for r in catalog.table("documents").filter(F.col("id").isin(*{r["document_id"] for r in rows})).collect()} if rows else {}
    hits = [{**r, "document_name": getattr(names.get(r["document_id"]), "name", ""), "file_path": getattr(names.get(r["document_id"]), "file_path", "")} for r in rows]
    if args.json:
        return sinks.search_json(args.query, hits)
    return "\n".join(f"{i}. [{r['score']:.4f}] {r['document_name'] or '(unknown)'} #{r.get('chunk_index', '')}: {sinks.shortened(r['text'], 200)}" for i, r in enumerate(hits, 1))


def list_(args, catalog: Catalog, config: settings.Config) -> str:
    offset = page_offset(args.limit, args.offset, args.page)
    query = DocumentQuery(args.search, parse_filters(args.filter), args.limit, offset)
    docs = catalog.table("documents")
    total = listing.count_documents(docs, query).first()["total"]
    rows = (r.asDict() for r in catalog.list_documents(query).toLocalIterator())
    if args.json:
        return sinks.documents_json(list(rows), total, offset)
    return _lines(rows, {"id": 18, "name": 30, "doc_type": 8, "status": 10})


def _lines(rows: Iterator[dict], columns: dict[str, int]) -> str:
    """A table whose lines are printed as rows come, a partition of them at a time, but for the last, which is returned."""
    last = sinks.text_table([], columns)
    for row in rows:
        print(last)
        last = sinks.text_table([row], columns).split("\n", 1)[1]
    return last


def delete(args, catalog: Catalog, config: settings.Config) -> str:
    return f"{catalog.delete_checked(args.id)} chunks deleted"


def gc(args, catalog: Catalog, config: settings.Config) -> str:
    return f"{catalog.count_orphans()} orphan chunks" if args.dry_run else f"{catalog.delete_orphans()} orphan chunks deleted"


def get_chunk(args, catalog: Catalog, config: settings.Config) -> str:
    row = listing.chunk_at(catalog.table("chunks"), catalog.table("documents"), args.document, args.index).first()
    if row is None:
        raise NotFoundError(f"no chunk {args.index} of {args.document}")
    return row["text"]


COMMANDS = {"add": add, "search": search, "list": list_, "delete": delete, "gc": gc, "get-chunk": get_chunk}


def wiki(args, catalog: Catalog) -> str:
    verb = args.wiki
    if verb == "index-list":
        return _lines((r.asDict() for r in catalog.indexes().toLocalIterator()), {"id": 34, "title": 30, "description": 40})
    if verb == "index-create":
        return catalog.add_index(args.title, args.description)
    if verb == "index-delete":
        if catalog.index(args.id) is None:
            raise NotFoundError(f"no index {args.id}")
        catalog.delete_index(args.id)
        return "deleted"
    if verb == "remember":
        return catalog.add_entry(args.index, args.title, body_of(args))
    if verb == "list":
        return _lines((r.asDict() for r in catalog.entries(args.index).toLocalIterator()), {"id": 34, "title": 30})
    entry = catalog.entry(args.id)
    if entry is None:
        raise NotFoundError(f"no entry {args.id}")
    if verb == "get":
        return entry["body"]
    if verb == "export":
        sinks.export_text(entry["body"], args.file)
        return args.file
    if verb == "forget":
        catalog.delete_entry(args.id)
        return "forgotten"
    body = entry["body"] if args.body is None and args.file is None else body_of(args)
    catalog.update_entry(args.id, args.title or entry["title"], body)
    return "updated"


def main() -> int:
    try:
        print(run(sys.argv[1:]))
        return 0
    except (NotFoundError, ValueError, KeyError, OSError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
