"""Files of many kinds as one table of texts.

The kind is the lower-cased extension; what isn't known is text. Kinds that are text are parsed by column expressions;
archives, PDF and XML by Python over Arrow batches. A file that can't be read is a row with its error, not a failed job.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as t
from larkspur.sources import office
from larkspur.sources.shipping import mapped

SCHEMA = "path string, text string, title string, file_type string, decrypted boolean, status string, error string"
OK, ENCRYPTED, UNREADABLE = "ok", "encrypted", "error"

#: Extensions of source code, which is cleaned like plain text.
CODE = (".go", ".py", ".js", ".ts", ".java", ".c", ".cpp", ".h", ".hpp", ".cs", ".php", ".rb", ".rs", ".swift", ".kt", ".scala", ".sh", ".bash", ".ps1", ".sql", ".css", ".scss", ".less")
MARKUP = (".html", ".htm")
XML = (".xml", ".svg")
BINARY = (".docx", ".xlsx", ".pptx", ".pdf", ".doc")


def extension(path: Column) -> Column:
    """The last extension of a path's last part, in lower case; empty without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def text_of(content: Column, kind: Column, keep_paragraphs: bool = True) -> Column:
    """The text of a file that is text. ``keep_paragraphs``: blank lines stay in plain texts, so that chunks can use them."""
    plain = t.tidy_paragraphs(content) if keep_paragraphs else t.clean_text(content)
    return (
        F.when(kind.isin(*MARKUP), t.html_text(content))
        .when(kind == ".json", t.json_strings(content))
        .when(kind.isin(".yaml", ".yml"), t.yaml_values(content))
        .when(kind == ".csv", t.csv_values(content))
        .when(kind == ".rtf", t.rtf_text(content))
        .when(kind.isin(*CODE), t.clean_text(content))
        .otherwise(plain)
    )


def file_type(kind: Column) -> Column:
    """The type that a kind is reported as."""
    return F.when(kind.isin(*MARKUP), ".html").when(kind.isin(*XML), ".xml").when(kind.isin(".yaml", ".yml"), ".yaml").otherwise(kind)


def parse_text_files(files: DataFrame, keep_paragraphs: bool = True) -> DataFrame:
    """SCHEMA of files (path, content) that are text."""
    kind = extension(F.col("path"))
    body = F.decode("content", "UTF-8") if dict(files.dtypes)["content"] == "binary" else F.col("content")
    return files.select(
        "path",
        text_of(body, kind, keep_paragraphs).alias("text"),
        F.when(kind.isin(*MARKUP), t.title_of(body)).otherwise("").alias("title"),
        file_type(kind).alias("file_type"),
        F.lit(False).alias("decrypted"),
        F.lit(OK).alias("status"),
        F.lit(None).cast("string").alias("error"),
    )


#: Characters of texts that are put out at once.
MOST_CHARS = 4 << 20


def parse_binary(path: str, data: bytes) -> tuple:
    """A row of SCHEMA."""
    kind = path[path.rfind(".") :].lower()
    try:
        if kind in XML:
            found = office.xml_text(data)
            text = data.decode(errors="replace") if found is None else found
            return path, text, "", ".xml", False, OK, None
        if kind == ".pdf":
            found = office.pdf_text(data)
            return path, found.text, "", kind, found.decrypted, OK, f"{found.unreadable} pages can't be read" if found.unreadable else None
        read = {".docx": office.docx_text, ".xlsx": office.xlsx_text, ".pptx": office.pptx_text, ".doc": office.legacy_doc_text}[kind]
        return path, read(data), "", kind, False, OK, None
    except office.EncryptedPdfError as e:
        return path, None, "", kind, False, ENCRYPTED, str(e)
    except Exception as e:  # one file's failure is its row's
        return path, None, "", kind, False, UNREADABLE, f"{type(e).__name__}: {e}"


def parse_binary_files(files: DataFrame) -> DataFrame:
    """SCHEMA of files (path, content) that need Python."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.bool_() if c.split()[1] == "boolean" else pa.string() for c in SCHEMA.split(", ")]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            rows, held = [], 0
            for path, data in zip(b.column(0), b.column(1), strict=True):
                rows.append(parse_binary(path.as_py(), data.as_py()))
                held += len(rows[-1][1] or "")
                if held > MOST_CHARS:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)

    parsed = mapped(files.select("path", "content"), run, SCHEMA)
    paged = F.col("file_type") == ".pdf"
    return parsed.withColumn("text", F.when(paged, t.tidy_paragraphs(F.col("text"))).otherwise(t.clean_text(F.col("text"))))


def parse_files(files: DataFrame, keep_paragraphs: bool = True) -> DataFrame:
    """SCHEMA of any files (path, content binary)."""
    python = extension(F.col("path")).isin(*XML, *BINARY)
    return parse_text_files(files.filter(~python), keep_paragraphs).unionByName(parse_binary_files(files.filter(python)))


def read_files(spark: SparkSession, path: str, keep_paragraphs: bool = True) -> DataFrame:
    """SCHEMA of the files at a path or glob; one that matches nothing is an error."""
    return parse_files(spark.read.format("binaryFile").load(path).select("path", "content"), keep_paragraphs)
