"""Text of binary documents, by the standard library: XML, office archives, legacy documents, PDF.

Each function takes a file's bytes. They run in ``parsers.read_files`` on executors, a file at a time.
"""

from __future__ import annotations

import bisect
import io
import re
import zipfile
import zlib
from xml.etree import ElementTree
from xml.parsers import expat

from larkspur.sources import pdf


class EncryptedPdfError(ValueError):
    """The document needs a password."""


class ParseError(ValueError):
    """The document holds no text that can be read."""


def xml_text(data: bytes) -> str | None:
    """Text right after opening tags, a space for every closing tag; None if it isn't well formed.

    Text after a closing tag isn't an element's own and is left out.
    """
    out: list[str] = []
    own = False

    def start(_name, _attributes) -> None:
        nonlocal own
        own = True

    def end(_name) -> None:
        nonlocal own
        own = False
        out.append(" ")

    def text(t: str) -> None:
        if own:
            out.append(t)

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    try:
        parser.Parse(data, True)
    except expat.ExpatError:
        return None
    return "".join(out)


def _local(tag: str) -> str:
    return tag[tag.rfind("}") + 1 :]


def _members(data: bytes, *patterns: str) -> list[list[bytes]]:
    """For each pattern the members of an archive whose name matches, by the number in their name; it is opened once."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        found = [sorted((n for n in names if re.fullmatch(p, n)), key=lambda n: (int((re.findall(r"\d+", n) or ["0"])[-1]), n)) for p in patterns]
        ends = sorted([*(i.header_offset for i in z.infolist()), z.start_dir])
        return [[_content(z, data, n, ends) for n in some] for some in found]


def _content(z: zipfile.ZipFile, data: bytes, name: str, ends: list[int]) -> bytes:
    """A member's bytes, cut out of the archive's where it is plainly stored or deflated; anything odd is left to zipfile.

    ``ends``: where members and the directory begin, in order. Most of the time of a small file went into opening members.
    """
    i = z.getinfo(name)
    at, own = i.header_offset, i.orig_filename.encode("utf-8" if i.flag_bits & 0x800 else "cp437")
    size, extra = (int.from_bytes(data[at + k : at + k + 2], "little") for k in (26, 28))
    begin, after = at + 30 + size + extra, bisect.bisect_right(ends, at)
    plain = i.compress_type in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) and not i.flag_bits & 0x61 and data[at : at + 4] == b"PK\x03\x04" and data[at + 30 : at + 30 + size] == own
    if plain and after < len(ends) and begin + i.compress_size <= ends[after]:
        raw = data[begin : begin + i.compress_size]
        try:
            out = raw if i.compress_type == zipfile.ZIP_STORED else zlib.decompressobj(-15).decompress(raw, i.file_size + 1)
        except zlib.error:
            return z.read(name)
        if len(out) == i.file_size and zlib.crc32(out) == i.CRC:
            return out
    return z.read(name)


def docx_text(data: bytes) -> str:
    """Runs of text of a word-processing document, one after the other."""
    (found,) = _members(data, r"word/document\.xml")
    if not found:
        raise ParseError("no word/document.xml")
    return "".join(e.text or "" for e in ElementTree.fromstring(found[0]).iter() if _local(e.tag) == "t")


def xlsx_text(data: bytes, inline_only: bool = False) -> str:
    """Cells of a workbook's sheets in order, a space after each.

    ``inline_only``: only strings that stand in the cells themselves, not those of the shared table.
    """
    tables, sheets = _members(data, r"xl/sharedStrings\.xml", r"xl/worksheets/sheet[^/]*\.xml")
    shared = [] if inline_only else [["".join(t.text or "" for t in item.iter() if _local(t.tag) == "t") for item in ElementTree.fromstring(m) if _local(item.tag) == "si"] for m in tables]
    table = [s for part in shared for s in part]
    out = []
    for sheet in sheets:
        for cell in (e for e in ElementTree.fromstring(sheet).iter() if _local(e.tag) == "c"):
            value = next((v.text for v in cell if _local(v.tag) == "v"), None)
            inline = "".join(t.text or "" for t in cell.iter() if _local(t.tag) == "t")
            if inline:
                out.append(inline)
            elif cell.get("t") == "s" and value and value.isdigit() and int(value) < len(table):
                out.append(table[int(value)])
            elif value and not inline_only and cell.get("t") != "s":
                out.append(value)
    return " ".join(out)


def pptx_text(data: bytes) -> str:
    """Runs of text of a presentation's slides by number, a space after each."""
    (slides,) = _members(data, r"ppt/slides/slide[^/]*\.xml")
    return " ".join(e.text for s in slides for e in ElementTree.fromstring(s).iter() if _local(e.tag) == "t" and e.text)


def legacy_doc_text(data: bytes) -> str:
    """Runs of four or more printable ASCII characters, but markup prologues; under 100 of them is an error."""
    runs = [r.decode() for r in re.findall(rb"[\x20-\x7E]{4,}", data)]
    text = re.sub(r"[\t\n\f\r ]+", " ", " ".join(r for r in runs if "<?xml" not in r and "<!DOCTYPE" not in r)).strip()
    if len(text) < 100:
        raise ParseError("this legacy document can't be read; convert it to .docx")
    return text


def pdf_text(data: bytes) -> pdf.PdfText:
    """A PDF's text: lines of each page, a blank line between pages. One without text is an error that says why."""
    try:
        found = pdf.read(data)
    except PermissionError as e:
        raise EncryptedPdfError(str(e)) from e
    if not found.pages:
        raise ParseError("the PDF has no pages")
    if not found.text:
        raise ParseError("the PDF has no text" + (f"; {found.unreadable} of {found.pages} pages can't be read" if found.unreadable else ""))
    return found
