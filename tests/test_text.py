"""Text functions against plain Python."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from larkspur.functions import text as t
from larkspur.functions.chunking import ChunkOptions, chunk_documents, chunks

PIECES = ["The", " ", "  ", "\n", "\n\n", "a.b", "É", "école", "机器学习", "，", "光", "GPT4模型", "don't", "!?", "\t", "ｘ", "한국", "😀", "x_y", "-", "かな", " ", "\x85", "0"]


def texts(n=300, seed=5):
    rnd = random.Random(seed)
    return ["", " ", *("".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 25))) for _ in range(n))]


def apply(spark, values, expression):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def is_word(c):
    if ord(c) < 128:
        return c.isascii() and c.isalnum()
    return unicodedata.category(c)[0] not in "PSZ" and not 0x80 <= ord(c) <= 0x9F


def is_cjk(c):
    name = unicodedata.name(c, "")
    return name.startswith(("CJK UNIFIED", "HIRAGANA", "KATAKANA", "HANGUL"))


def words_of(text):
    out, run = [], ""
    for c in [*text, " "]:
        if is_word(c):
            run += c
            continue
        for part in re.findall(r"\0+|[^\0]+", "".join("\0" if is_cjk(x) else x for x in run)):
            own, run = run[: len(part)], run[len(part) :]
            if part[0] == "\0":
                for i, x in enumerate(own):
                    out.append(x)
                    if i + 1 < len(own):
                        out.append(own[i : i + 2])
            else:
                out.append("".join(x.lower() if x.isascii() else x for x in own))
        run = ""
    return out


def test_tokenize_examples(spark):
    given = ["Hello World", "machine-learning", "  spaces  ", "", "机器学习", "光", "GPT4模型", "École", None]
    wanted = [["hello", "world"], ["machine", "learning"], ["spaces"], [], ["机", "机器", "器", "器学", "学", "学习", "习"], ["光"], ["gpt4", "模", "模型", "型"], ["École"], []]
    assert apply(spark, given, t.tokenize)[:-1] == wanted[:-1]


def test_tokenize_like_plain_python(spark):
    values = texts()
    assert apply(spark, values, t.tokenize) == [words_of(x) for x in values]


def test_clean_text(spark):
    assert apply(spark, ["  a \n\t b ", "", "\x0b a"], t.clean_text) == ["a b", "", "a"]


@pytest.mark.parametrize(
    ("html", "wanted"),
    [
        ("<p>a</p><script>x<b></script>c", "ac"),
        ("a<script>1<script>2</script>3</script>b", "ab"),
        ("a<script>never closed", "a"),
        ("a > b < c", "a b"),
        ("</script>a", "a"),
        ("<style a='b'>x</style>&amp;", "&amp;"),
        ("", ""),
    ],
)
def test_html_text(spark, html, wanted):
    assert apply(spark, [html], t.html_text) == [wanted]


def test_formats(spark):
    assert apply(spark, ['{"a": "b\\"c", "d": "[x", "e": ""}'], t.json_strings) == ['a b\\"c d e']
    assert apply(spark, ["# c\nk: v\n- item\nm: {x\n: none\na:b:c"], t.yaml_values) == ["v b:c"]
    assert apply(spark, ['a, "b" ,"\n",,c d'], t.csv_values) == ["a b c d"]
    assert apply(spark, [r"{\rtf1 a\par b\'e9c}"], t.rtf_text) == ["a b c"]
    assert apply(spark, ["```json\n{}\n```", "{}"], t.unfenced) == ["{}", "{}"]
    assert apply(spark, ["<title x='1'> a  b </title>", "no"], t.title_of) == ["a b", ""]
    assert apply(spark, [r"5%_\x"], t.escape_like) == [r"5\%\_\\x"]


def test_sentences(spark):
    assert apply(spark, ["One. Two? Three", "", "a\nb!"], t.sentences) == [["One.", "Two?", "Three"], [""], ["a b!"]]
    assert apply(spark, ["3.5 is. Next！ x\ny", "。"], t.index_sentences) == [["3.5 is.", "Next！", "x\ny"], ["。"]]
    assert apply(spark, ["a\r\n\r\n b \n\n\n\n" + "x" * 7], lambda c: t.index_paragraphs(c, 3)) == [["a", "b", "xxx", "xxx", "x"]]
    assert apply(spark, ["abcdefg", "é", None], t.estimated_tokens) == [1, 0, None]


def plain_chunks(text, most, overlap, hard, separator="\n\n"):
    size = lambda s: len(s.encode()) // 4

    def pack(parts):
        out, b = [], ""
        for p in parts:
            if b and size(f"{b} {p}") > hard:
                out.append(b)
                b = ""
            b = f"{b} {p}" if b else p
        return [*out, b] if b else out

    out, buffer = [], ""

    def flush():
        nonlocal buffer
        if content := buffer.strip():
            if size(content) > hard:
                sentences = [s.strip() for s in re.findall(r"[^.?!]*[.?!]|[^.?!]+$", content.replace("\n", " "))]
                for s in pack([s for s in sentences if s]):
                    out.extend(pack(s.split()) if size(s) > hard else [s])
            else:
                out.append(content)
            ws = content.split()
            buffer = content if len(ws) <= overlap else " ".join(ws[len(ws) - overlap :]) if overlap else ""

    for p in text.replace("\r\n", "\n").split(separator):
        if not (p := p.strip()):
            continue
        if buffer and size(f"{buffer}\n\n{p}") > most:
            flush()
        buffer = f"{buffer}\n\n{p}" if buffer else p
    flush()
    return out


@pytest.mark.parametrize(("most", "overlap", "hard"), [(8, 2, 20), (5, 0, 8), (12, 100, 40)])
def test_chunks_like_plain_python(spark, most, overlap, hard):
    rnd = random.Random(most)
    values = ["", "one", "a\r\n\r\nb", *("".join(rnd.choice(["word ", "x. ", "long" * 9, "\n\n", "\n", "éé ", "end? "]) for _ in range(rnd.randint(0, 40))) for _ in range(150))]
    got = apply(spark, values, lambda c: chunks(c, ChunkOptions(most, overlap, hard)))
    assert got == [plain_chunks(x, most, overlap, hard) for x in values]


def test_chunks_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = chunk_documents(docs, ChunkOptions(128, 20, separator="\n"), "doc_id").collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.document_id, r.chunk_index)):
        by.setdefault(r.document_id, []).append(r.text)
    assert by == {r.doc_id: plain_chunks(r.text, 128, 20, 8192, "\n") for r in docs.collect()}
    assert len({r.id for r in got}) == len(got)


def test_sized_options():
    assert ChunkOptions.sized(500) == ChunkOptions(500, 100)
