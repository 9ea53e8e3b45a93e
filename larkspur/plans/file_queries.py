"""Queries of the parsers: files of each kind made of the driver's rows, and what is read of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.plans.tables import by_work, table
from larkspur.sources.parsers import parse_files


def _little_endian(value: Column, size: int) -> Column:
    """A number's bytes as hexadecimal digits, the lowest first."""
    digits = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.concat(*[F.substr(digits, F.lit(2 * i + 1), F.lit(2)) for i in range(size - 1, -1, -1)])


def _archive(name: str, content: Column) -> Column:
    """An archive that stores one member as it is."""
    body, crc, size = F.hex(F.encode(content, "UTF-8")), F.crc32(content), F.octet_length(content)
    called = name.encode().hex()
    sizes = F.concat(_little_endian(crc, 4), _little_endian(size, 4), _little_endian(size, 4), F.lit(f"{len(name).to_bytes(2, 'little').hex()}0000"))
    local = F.concat(F.lit("504b0304" + "1400" + "00" * 8), sizes, F.lit(called), body)
    listed = F.concat(F.lit("504b0102" + "1400" * 2 + "00" * 8), sizes, F.lit("00" * 10 + "00" * 4 + called))
    end = F.concat(F.lit("504b0506" + "00" * 4 + "0100" * 2 + (46 + len(name)).to_bytes(4, "little").hex()), _little_endian(F.octet_length(content) + 30 + len(name), 4), F.lit("0000"))
    return F.unhex(F.concat(local, listed, end))


def _event(before: str, between: str, after: str) -> Column:
    return F.concat(F.lit(before), "event_type", F.lit(between), F.col("user_id").cast("string"), F.lit(after))


def _pdf() -> Column:
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R] >>", "<< /Type /Page /Contents 4 0 R >>"]
    head = "%PDF-1.4\n" + "".join(f"{n} 0 obj\n{o}\nendobj\n" for n, o in enumerate(objects, 1))
    return _event(head + "4 0 obj\n<< >>\nstream\nBT /F1 12 Tf 1 0 0 1 72 600 Tm (user ", ") Tj 1 0 0 1 72 700 Tm (", ") Tj ET\nendstream\nendobj\ntrailer << /Root 1 0 R >>")


#: name: extension, and the content of a file made of an event.
_FILES: dict[str, tuple[str, Callable[[], Column]]] = {
    "markdown_files": (".MD", lambda: _event("# ", " \r\n\r\n\tuser  ", "\n\n\n")),
    "code_files": (".py", lambda: _event("", "\n\n    user ", "\n")),
    "html_files": (".htm", lambda: _event("<html><title>t</title><script>x</script><p>", "</p> user <b>", "</b></html>")),
    "xml_files": (".xml", lambda: _event("<e><t>", "</t><u>user ", "</u></e>")),
    "docx_files": (".docx", lambda: _archive("word/document.xml", _event('<w:d xmlns:w="u"><w:t>', " </w:t><w:t>user ", "</w:t></w:d>"))),
    "xlsx_files": (".xlsx", lambda: _archive("xl/worksheets/sheet1.xml", _event('<x xmlns="u"><c t="inlineStr"><is><t>', '</t></is></c><c t="inlineStr"><is><t>user</t></is></c><c><v>', "</v></c></x>"))),
    "pptx_files": (".pptx", lambda: _archive("ppt/slides/slide1.xml", _event('<a xmlns="u"><t>', "</t><t>user</t><t>", "</t></a>"))),
    "pdf_files": (".pdf", _pdf),
    "legacy_files": (".doc", lambda: _event("\x01\x02" + "w" * 100 + "\x00", "\x01ab\x02user ", "\x00<?xml no")),
    "broken_files": (".docx", lambda: _event("no archive ", " user ", "")),
}


def _read(extension: str, content: Callable[[], Column]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        made = content()
        events = by_work(table(spark, sf, "events").select("event_id", "event_type", "user_id"), "event_id")
        files = events.select(F.concat(F.lit("in/"), "event_id", F.lit(extension)).alias("path"), made.cast("binary").alias("content"))
        return parse_files(files).select("path", "text", "title", "file_type", "status")

    return query


QUERIES = {name: _read(*made) for name, made in _FILES.items()}


def _sql(name: str, text: str, file_type: str, title: str = "", status: str = "ok") -> str:
    return f"SELECT 'in/' || event_id || '{_FILES[name][0]}' AS path, {text} AS text, '{title}' AS title, '{file_type}' AS file_type, '{status}' AS status FROM events"


_SAID = "event_type || ' user ' || user_id"
SQL = {
    "markdown_files": _sql("markdown_files", "'# ' || event_type || chr(10) || chr(10) || 'user ' || user_id", ".md"),
    "code_files": _sql("code_files", _SAID, ".py"),
    "html_files": _sql("html_files", "'t' || event_type || ' user ' || user_id", ".html", "t"),
    "xml_files": _sql("xml_files", _SAID, ".xml"),
    "docx_files": _sql("docx_files", _SAID, ".docx"),
    "xlsx_files": _sql("xlsx_files", _SAID, ".xlsx"),
    "pptx_files": _sql("pptx_files", _SAID, ".pptx"),
    "pdf_files": _sql("pdf_files", "user_id || ' user ' || event_type", ".pdf"),
    "legacy_files": _sql("legacy_files", "repeat('w', 100) || ' ' || CASE WHEN length(event_type) >= 4 THEN event_type || ' ' ELSE '' END || 'user ' || user_id", ".doc"),
    "broken_files": _sql("broken_files", "NULL::VARCHAR", ".docx", status="error"),
}
