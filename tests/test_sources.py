"""Parsers of generated files, models with stand-in services, settings, commands, streams."""

import hashlib
import io
import json
import time
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from larkspur.plans import cli, sinks
from larkspur.plans import config as settings
from larkspur.sources import models, office, parsers
from larkspur.sources import pdf as pdf_reader
from larkspur.sources.catalog import Catalog
from larkspur.sources.ciphers import Aes, rc4
from larkspur.streaming.ingest import Batches, follow_folder


def archive(**members):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), body)
    return data.getvalue()


def pdf(*pages, packed=False, extra=b"", broken=None):
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] >>" % b" ".join(b"%d 0 R" % (3 + 2 * i) for i in range(len(pages)))]
    for i, lines in enumerate(pages):
        content = b"BT /F1 12 Tf 72 700 Td " + b" 0 -14 Td ".join(b"(%s) Tj" % x for x in lines) + b" ET"
        if packed:
            content = zlib.compress(content)
        if broken == i:
            content = b"\x00broken"
        head = b"<< /Length %d%s >>" % (len(content), b" /Filter /FlateDecode" if packed or broken == i else b"")
        objects += [b"<< /Type /Page /Contents %d 0 R >>" % (len(objects) + 2), head + b"\nstream\n" + content + b"\nendstream"]
    return pdf_of(objects, extra)


def pdf_of(objects, extra=b""):
    body = b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in enumerate(objects, 1))
    return b"%PDF-1.4\n" + body + b"trailer << /Root 1 0 R" + extra + b" >>\nstartxref\n0\n%%EOF"


def stream(content, head=b""):
    return b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(content), head, content)


def test_office():
    assert office.docx_text(archive(word__document_xml='<w:d xmlns:w="u"><w:t>Hel</w:t><w:t xml:space="preserve">lo &amp; </w:t></w:d>')) == "Hello & "
    sheet = '<x xmlns="u"><c t="s"><v>1</v></c><c t="inlineStr"><is><t>in</t></is></c><c><v>4.5</v></c></x>'
    book = archive(xl__sharedStrings_xml='<sst xmlns="u"><si><t>a</t></si><si><r><t>b</t></r><r><t>c</t></r></si></sst>', xl__worksheets__sheet1_xml=sheet)
    assert office.xlsx_text(book) == "bc in 4.5" and office.xlsx_text(book, inline_only=True) == "in"
    assert office.pptx_text(archive(ppt__slides__slide10_xml='<a xmlns="u"><t>last</t></a>', ppt__slides__slide2_xml='<a xmlns="u"><t>first</t></a>')) == "first last"
    assert office.xml_text(b"<a>x<b>y</b>z<c>w</c></a>") == "xy w  " and office.xml_text(b"<a>") is None
    with pytest.raises(office.ParseError):
        office.legacy_doc_text(b"\x00short")
    assert office.legacy_doc_text(b"\x01" + b"long text " * 12 + b"\x00<?xml ver\x00abc") == ("long text " * 12).strip()


def read(data):
    found = office.pdf_text(data)
    return found.text, found.unreadable


def test_pdf():
    assert read(pdf([b"one", b"t\\(w\\)o"], [b"three"])) == ("one\nt(w)o\n\nthree", 0)
    assert read(pdf([b"caf\\351"], packed=True)) == ("café", 0)
    assert read(pdf([b"x"], [b"y"], broken=0)) == ("y", 1)
    assert read(pdf([b"x"], extra=b" /Encrypt 99 0 R")) == ("x", 0)  # what it names isn't there
    for bad in (pdf(), pdf([b""]), b"", b"%PDF-1.4 nothing", pdf([b"x"], broken=0)):
        with pytest.raises(office.ParseError):
            office.pdf_text(bad)


def test_pdf_order_fonts_and_places():
    tree = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [6 0 R 3 0 R 6 0 R] /Resources << /Font << /F1 8 0 R /F2 9 0 R >> >> >>", b"<< /Type /Page /Contents 4 0 R >>"]
    second = b"BT /F1 10 Tf 1 0 0 1 200 500 Tm (right) Tj 1 0 0 1 50 500 Tm (left) Tj 1 0 0 1 50 600 Tm [(to) -50 (p) -600 (line)] TJ 12 TL T* (next) Tj ET BT /F2 10 Tf 50 100 Td <00010002> Tj ET"
    codes = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0001> <4E2D> endbfchar 1 beginbfrange <0002> <0005> <6587> endbfrange"
    objects = [*tree, stream(second), b"null", b"<< /Type /Page /Contents [7 0 R] >>", stream(b"q 1 0 0 1 0 9 cm BT /F1 9 Tf 5 5 Td (first \\101\\200) Tj ET Q")]
    objects += [b"<< /Type /Font /Encoding << /Differences [65 /Adieresis 128 /Euro /uni0416] >> >>", b"<< /Type /Font /Subtype /Type0 /ToUnicode 10 0 R >>", stream(codes)]
    assert read(pdf_of(objects)) == ("first Ä€\n\ntop line\nnext\nleft right\n中文", 0)


def test_pdf_object_streams_and_changes():
    inner = b"1 0 2 34 <</Type /Catalog /Pages 2 0 R >>  << /Type /Pages /Kids [4 0 R] >>"
    first = inner.index(b"<<")
    packed = zlib.compress(inner)
    data = b"%PDF-1.5\n3 0 obj\n" + stream(packed, b" /Type /ObjStm /N 2 /First %d /Filter /FlateDecode" % first) + b"\nendobj\n4 0 obj\n<< /Type /Page /Contents 5 0 R >>\nendobj\n"
    old, new = (b"5 0 obj\n" + stream(b"BT (%s) Tj ET" % t) + b"\nendobj\n" for t in (b"old", b"new"))
    assert read(data + old + new + b"6 0 obj\n" + stream(b"", b" /Type /XRef /Root 1 0 R") + b"\nendobj\nstartxref\n0\n%%EOF") == ("new", 0)


def test_ciphers():
    for bits, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        aes = Aes(bytes(range(bits)))
        assert aes.cbc_encrypted(bytes(16), bytes.fromhex("00112233445566778899aabbccddeeff")).hex() == want
        data = bytes(range(160))
        assert aes.cbc_decrypted(b"x" * 16, aes.cbc_encrypted(b"x" * 16, data)) == data
    assert rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"


def locked(method, password=b""):
    """A PDF of one page, encrypted by the rules for one method, with ``password``."""
    pad = lambda p: (p + pdf_reader._FILL)[:32]
    key, content, ids = b"k" * 32, b"BT (secret words) Tj ET", b"0123456789abcdef"
    filled = lambda d: d + bytes([16 - len(d) % 16]) * (16 - len(d) % 16)
    text = lambda b: b"<" + b.hex().encode() + b">"
    if method == "AESV3":
        u = pdf_reader.Security._hash(b"validate" if not password else b"other", 6) + b"validate" + b"key salt"
        ue = Aes(pdf_reader.Security._hash(b"key salt", 6)).cbc_encrypted(bytes(16), key)
        said = b"/V 5 /R 6 /StmF /S /CF << /S << /CFM /AESV3 >> >> /O <00> /U %s /UE %s" % (text(u), text(ue))
        hidden = b"i" * 16 + Aes(key).cbc_encrypted(b"i" * 16, filled(content))
    else:
        revision, size = {"RC4-40": (2, 5), "RC4-128": (3, 16), "AESV2": (4, 16)}[method]
        key = hashlib.md5(pad(password) + b"o" * 32 + (0xFFFFFFFC).to_bytes(4, "little") + ids).digest()
        for _ in range(50 if revision > 2 else 0):
            key = hashlib.md5(key[:size]).digest()
        key = key[:size]
        u = rc4(key, pdf_reader._FILL) if revision == 2 else hashlib.md5(pdf_reader._FILL + ids).digest()
        for n in range(20 if revision > 2 else 0):
            u = rc4(bytes(b ^ n for b in key), u)
        said = b"/V %d /R %d /Length %d /P -4 /O %s /U %s" % (1 if size == 5 else 4 if method == "AESV2" else 2, revision, size * 8, text(b"o" * 32), text(u.ljust(32, b"\0")))
        said += b" /StmF /S /CF << /S << /CFM /AESV2 >> >>" if method == "AESV2" else b""
        own = hashlib.md5(key + (4).to_bytes(3, "little") + bytes(2) + (b"sAlT" if method == "AESV2" else b"")).digest()[: min(16, size + 5)]
        hidden = b"i" * 16 + Aes(own).cbc_encrypted(b"i" * 16, filled(content)) if method == "AESV2" else rc4(own, content)
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] >>", b"<< /Type /Page /Contents 4 0 R >>", stream(hidden), b"<< /Filter /Standard %s >>" % said]
    return pdf_of(objects, b" /Encrypt 5 0 R /ID [%s %s]" % (text(ids), text(ids)))


@pytest.mark.parametrize("method", ["RC4-40", "RC4-128", "AESV2", "AESV3"])
def test_encrypted_pdf(method):
    found = office.pdf_text(locked(method))
    assert found.text == "secret words" and found.decrypted
    assert parsers.parse_binary("a.pdf", locked(method))[4] is True
    with pytest.raises(office.EncryptedPdfError):
        office.pdf_text(locked(method, b"user's own"))



def test_files(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("one\n two\n\n three")
    (tmp_path / "b.html").write_text("<title>T</title><p>x</p><script>y</script>")
    (tmp_path / "c.xml").write_text("<a>q<b>r</b></a>")
    (tmp_path / "d.pdf").write_bytes(pdf([b"p"], [b"q"]))
    (tmp_path / "e.pdf").write_bytes(locked("RC4-128", b"user's"))
    (tmp_path / "f.docx").write_bytes(b"not a zip")
    (tmp_path / "g").write_text("no extension")
    (tmp_path / "h.py").write_text("def f():\n\n    pass")
    got = {r.path.rpartition("/")[2]: r for r in parsers.read_files(spark, f"file://{tmp_path}").collect()}
    assert {k: (r.text, r.file_type, r.status) for k, r in got.items()} == {
        "a.TXT": ("one two\n\nthree", ".txt", "ok"), "b.html": ("Tx", ".html", "ok"), "c.xml": ("qr", ".xml", "ok"), "d.pdf": ("p\n\nq", ".pdf", "ok"),
        "e.pdf": (None, ".pdf", "encrypted"), "f.docx": (None, ".docx", "error"), "g": ("no extension", "", "ok"), "h.py": ("def f(): pass", ".py", "ok"),
    }
    assert got["b.html"].title == "T"
    flat = parsers.read_files(spark, f"file://{tmp_path}/a.TXT", keep_paragraphs=False).first()
    assert flat.text == "one two three"
    with pytest.raises(Exception):
        parsers.read_files(spark, f"file://{tmp_path}/missing").collect()


def test_embedder():
    calls, pauses = [], []

    def send(url, body, key, timeout):
        calls.append((url, body["input"]))
        if len(calls) <= 12:
            raise models.HttpError(429, "slow", 3.0)
        return {"data": [{"index": i, "embedding": [float(len(t))]} for i, t in reversed(list(enumerate(body["input"])))]}

    e = models.HttpEmbedder("http://h/v1", "m", max_batch=2, send=send, sleep=pauses.append)
    assert e(["a", "bb", "ccc"]) == [[1.0], [2.0], [3.0]]
    assert calls[0] == ("http://h/v1/embeddings", ["a", "bb"]) and pauses[0] == 3.0 and max(pauses) == 30.0

    def down(*_):
        raise models.HttpError(500, "down")

    with pytest.raises(models.HttpError):
        models.HttpEmbedder("http://h", "m", send=down, sleep=pauses.append)(["a"])
    with pytest.raises(models.HttpError):
        models.HttpEmbedder("http://h", "m", send=lambda *_: (_ for _ in ()).throw(models.HttpError(400, "bad")), sleep=pauses.append)(["a"])
    assert models.join_url("http://h/", "/e") == "http://h/v1/e" and models.join_url("http://h/api/v3", "/e") == "http://h/api/v3/e"
    assert models.retry_after("7") == 7 and models.retry_after("x") == 0 and models.retry_after(None) == 0
    assert models.retry_after("Thu, 01 Jan 1970 00:01:40 GMT", now=40.0) == 60
    with pytest.raises(ValueError):
        models.embed_text(None, "x")
    with pytest.raises(ValueError):
        models.embed_text(lambda t: [], "x")


def test_other_models(spark):
    rows = [{"id": i, "text": f"t{i}", "score": 0.0} for i in range(3)]
    ranked = models.HttpReranker("u", "m", send=lambda *_: {"results": [{"index": 2, "relevance_score": 0.9}, {"index": 0, "relevance_score": 0.1}, {"index": 7, "relevance_score": 1}]})
    assert [(r["id"], r["score"]) for r in ranked("q", rows)] == [(2, 0.9), (0, 0.1)]
    assert [models.HttpEvaluator("u", send=lambda *_, q=q: {"quality": q})("q", rows) for q in ("high", "LOW", "what")] == ["HIGH", "LOW", "UNCERTAIN"]
    web = models.HttpWebSearch("u", send=lambda *_: {"results": [{"url": "p", "title": "T", "score": 0.5}, {"url": "o", "content": "C"}]})
    assert [(r["id"], r["document_id"], r["text"]) for r in web("q", 2)] == [("web-0", "p", "T"), ("web-1", "o", "C")]
    assert models.HttpRewriter("u", send=lambda *_: {"queries": ["a", " a ", "", "b"]})("q", 3) == ["a", "b"]
    chat = models.ChatClient("http://h", "m", send=lambda *_: {"choices": [{"message": {"content": '```json\n{"a": 1}\n```'}}]})
    assert chat.complete_json("p") == {"a": 1}
    got = models.embed_chunks(spark.createDataFrame([(1, "ab"), (2, None)], "id long, text string"), lambda ts: [[float(len(t))] for t in ts]).collect()
    assert [(r.id, r.embedding) for r in sorted(got)] == [(1, [2.0]), (2, [0.0])]
    assert models.LocalEmbedder("m", send=lambda *_: {"embedding": [1.0]})(["a", "b"]) == [[1.0], [1.0]]


def test_settings(tmp_path):
    path, old = tmp_path / "new" / "c.yml", tmp_path / "old.yml"
    assert settings.load(path).get("chunking.max-tokens") == "512"
    old.write_text("embedding:\n  api_key: sk-1234567890\n  max-batch: 3\nother: {}\n")
    c = settings.load(path, old)
    assert path.exists() and c.get("embedding.api-key") == "sk-1234567890" and c.display("embedding.api-key") == "sk-1...7890" and c.embedding.max_batch == 0
    c.set("query-rewrite.enabled", "true")
    c.set("chunking.overlap", "-4")
    c.set("chunking.max-tokens", "64")
    settings.save(c, path)
    again = settings.load(path)
    assert again == c and again.query_rewrite.enabled and again.chunking == settings.Chunking(64, 100)
    for bad in ("x.y", "embedding.nope", "embedding"):
        with pytest.raises(KeyError):
            c.get(bad)
    assert len(c.keys()) >= 21


def test_sinks(tmp_path):
    assert sinks.shortened("a" * 18) == "a" * 18 and sinks.shortened("a" * 19) == "a" * 15 + "..." and sinks.shortened("é" * 10) == "é" * 7 + "..."
    assert [sinks.masked(x) for x in ("", "12345678", "123456789")] == ["(not set)", "****", "1234...6789"]
    assert [sinks.duration(s) for s in (5, 125, 3720)] == ["5s", "2m5s", "1h2m"]
    assert json.loads(sinks.search_json("<q>", [])) == {"query": "<q>", "count": 0, "results": []} and "<q>" in sinks.search_json("<q>", [])
    assert sinks.progress(50, 100, 10) == "50/100 chunks, 0 failed batches, 5.0 chunks/s, 10s left" and sinks.progress(0, 9, 0, 1).endswith("unknown left")
    sinks.export_text("é", f"{tmp_path}/x")
    assert (tmp_path / "x").read_bytes() == "é".encode()


def test_commands(spark, tmp_path):
    conf = tmp_path / "c.yml"
    run = lambda *a: cli.run(["--config", str(conf), *a], spark)
    run("init")
    run("config", "set", "storage.path", f"file://{tmp_path}/store")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "leaf.txt").write_text("\n\n".join(f"Photosynthesis in leaf {i} makes sugar." for i in range(8)))
    (tmp_path / "in" / "bad.pdf").write_bytes(locked("RC4-128", b"user's"))
    added = run("add", f"file://{tmp_path}/in", "--chunk-size", "30", "--overlap", "2")
    assert added.startswith("1 documents added") and "encrypted" in added
    assert run("add", f"file://{tmp_path}/in").startswith("0 documents") and run("add", "--force", f"file://{tmp_path}/in", "--chunk-size", "30").startswith("1 documents")
    page = json.loads(run("list", "--json", "--filter", "status=indexed", "--limit", "5", "--page", "1"))
    assert page["total"] == page["count"] == 1
    doc = page["documents"][0]["id"]
    hits = json.loads(run("search", "photosynthesis", "--json"))
    assert hits["count"] and hits["results"][0]["document_name"] == "leaf.txt"
    assert "leaf.txt" in run("search", "sugar") and "leaf.txt" in run("list")
    assert run("get-chunk", doc, "0").startswith("Photosynthesis")
    with pytest.raises(LookupError):
        run("get-chunk", doc, "99")
    index = run("wiki", "index-create", "T")
    entry = run("wiki", "remember", index, "E", "--body", " text ")
    assert run("wiki", "get", entry) == "text" and "E" in run("wiki", "list", index) and "T" in run("wiki", "index-list")
    run("wiki", "update", entry, "--body", "more")
    assert run("wiki", "export", entry, f"{tmp_path}/out.txt") and (tmp_path / "out.txt").read_text() == "more"
    with pytest.raises(ValueError):
        run("wiki", "remember", index, "E")
    assert run("wiki", "forget", entry) == "forgotten" and run("wiki", "index-delete", index) == "deleted"
    assert run("gc", "--dry-run") == "0 orphan chunks" and run("delete", doc).endswith("chunks deleted")
    with pytest.raises(LookupError):
        run("delete", doc)


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    catalog = Catalog(spark, f"file://{tmp_path}/store")
    seen, listener = [], Batches()
    spark.streams.addListener(listener)
    for i in range(2):
        (folder / f"{i}.txt").write_text(f"text number {i}")
        follow_folder(spark, f"file://{folder}", catalog, f"file://{tmp_path}/cp", told=lambda n, done: seen.append((n, done.documents, done.chunks, done.failed))).awaitTermination()
    assert seen == [(0, 1, 1, 0), (1, 1, 1, 0)]
    for _ in range(100):
        if len(listener.batches) == 2:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert [b[0] for b in listener.batches] == [0, 1] and all(b[1] > 0 and b[2] > 0 for b in listener.batches) and listener.error is None
    assert sorted(r.text for r in catalog.live_chunks().collect()) == ["text number 0", "text number 1"]


def test_stream_keeps_the_index(spark, tmp_path):
    from larkspur.operators import bm25

    folder, catalog = tmp_path / "in", Catalog(spark, f"file://{tmp_path}/base", indexed=True)
    folder.mkdir()
    for n in range(3):
        for i in range(2):
            (folder / f"{n}-{i}.txt").write_text(f"text number {n * 2 + i} of the batch " + "word " * (n + i))
        follow_folder(spark, f"file://{folder}", catalog, f"file://{tmp_path}/cp").awaitTermination()
    pairs = lambda df: sorted(map(tuple, df.collect()))

    def current():
        chunks, index = catalog.table("chunks"), catalog.keyword_index()
        assert pairs(index.document_frequencies()) == pairs(bm25.document_frequencies(bm25.term_frequencies(chunks)))
        assert index.statistics().first() == bm25.corpus_statistics(chunks).first()
        asked = spark.createDataFrame([(0, "number word"), (1, "batch 3")], "query_id long, query string")
        assert pairs(index.search(asked, 3)) == pairs(bm25.bm25_search(chunks, asked, 3))
        return index

    assert sum(len(parts) for _, parts in current().generations) == 3
    gone = catalog.table("documents").filter(F.col("name").isin("0-1.txt", "2-0.txt")).select("id")
    assert catalog.delete_documents(gone) == 2 and current().hidden.count() == 2
    catalog.compact("chunks", "documents")
    catalog.vacuum()
    assert current().hidden is None and len(list((tmp_path / "base/terms/postings").iterdir())) == 1
    with pytest.raises(ValueError, match="without an index"):
        plain = Catalog(spark, f"file://{tmp_path}/plain")
        plain.add_documents([{"id": "d", "name": "n", "file_path": "p"}])
        plain.add_chunks([{"document_id": "d", "chunk_index": 0, "text": "t"}])
        plain.keyword_index()


def test_web_results_and_lateral_rewrites(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from larkspur.sources import web

    class Answers(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(500 if "fail" in asked["query"] else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"results": [{"url": f"u/{asked['query']}/{i}", "title": f"t{i}", "score": 1 / (i + 1)} for i in range(4)]}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    web.register(spark)
    read = spark.read.format("web_results").option("url", f"http://127.0.0.1:{server.server_port}/s").option("top_k", 2).option("queries", json.dumps(["one", "fail", "two"]))
    rows = read.load()
    assert rows.rdd.getNumPartitions() == 3
    assert [(r.query_id, r.id, r.document_id, r.score) for r in rows.orderBy("query_id", "id").collect() if r.error is None] == [(0, "web-0", "u/one/0", 1.0), (0, "web-1", "u/one/1", 0.5), (2, "web-0", "u/two/0", 1.0), (2, "web-1", "u/two/1", 0.5)]
    assert [r.query for r in rows.filter("error is not null").collect()] == ["fail"]
    with pytest.raises(Exception, match="500"):
        read.option("strict", True).load().collect()
    with pytest.raises(Exception, match="needs the options"):
        spark.read.format("web_results").option("url", "x").load().collect()
    rows.createOrReplaceTempView("found_pages")
    assert spark.sql("SELECT count(*) FROM found_pages WHERE score > 0.6").first()[0] == 2
    server.shutdown()
    asked = spark.createDataFrame([(0, " 细胞的能量工厂是什么 "), (1, "plain"), (2, None), (3, "")], "query_id long, query string")
    got = spark.sql("SELECT query_id, variant, rewritten FROM {asked}, LATERAL rewritten(query, 3) ORDER BY 1, 2", asked=asked).collect()
    assert [tuple(r) for r in got] == [(0, 0, "细胞的能量工厂是什么"), (0, 1, "细胞的线粒体是什么"), (1, 0, "plain")]


def test_files_are_parsed_by_all_cores(spark):
    from larkspur.plans import file_queries, tables

    for name in ("pdf_files", "xlsx_files", "docx_files", "pptx_files"):
        assert file_queries.QUERIES[name](spark, "/root/testdata/sf0.001").toDF("path", "text", "title", "file_type", "status")._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 1
    assert tables.by_work(spark.range(100), "id", rows=3).rdd.getNumPartitions() == 34


def test_workbooks_are_opened_once(monkeypatch):
    opened, whole = [], zipfile.ZipFile
    data = io.BytesIO()
    with whole(data, "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>a</t></si><si><t>b</t></si></sst>")
        z.writestr("xl/worksheets/sheet2.xml", '<s><c t="s"><v>1</v></c></s>')
        z.writestr("xl/worksheets/sheet1.xml", '<s><c t="s"><v>0</v></c><c><v>7</v></c></s>')
    monkeypatch.setattr(office.zipfile, "ZipFile", lambda *a: opened.append(1) or whole(*a))
    assert office.xlsx_text(data.getvalue()) == "a 7 b" and len(opened) == 1


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2])
def test_members_are_cut_out_of_archives(monkeypatch, method):
    made, runs = io.BytesIO(), b"<w:d xmlns:w=\"u\">" + b"<w:t>r\xc3\xa4n </w:t>" * 50 + b"</w:d>"
    with zipfile.ZipFile(made, "w", method) as z:
        for name, content in (("a/\u00e4.txt", b"x"), ("word/document.xml", runs), ("word/other.xml", b"<o/>"), ("ppt/slides/slide1.xml", b"<a><t>1</t></a>"), ("ppt/slides/slide2.xml", b"<a/>")):
            z.writestr(name, content)
    data, opened, read = made.getvalue(), [], zipfile.ZipFile.read
    monkeypatch.setattr(zipfile.ZipFile, "read", lambda self, *a: opened.append(a) or read(self, *a))
    for some in (data, b"before it" + data):
        assert office.docx_text(some) == "r\u00e4n " * 50 and office.pptx_text(some) == "1"
    assert len(opened) == (6 if method == zipfile.ZIP_BZIP2 else 0)
    # what is damaged is still told by zipfile: a sum, a name in the member's own head, a head that isn't there
    at = data.index(b"word/document.xml")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        listed = data.index(b"word/document.xml", z.start_dir)
    for where in (listed - 46 + 16, at, at - 30):
        broken = bytearray(data)
        broken[where] ^= 1
        with pytest.raises(zipfile.BadZipFile):
            office.docx_text(bytes(broken))
