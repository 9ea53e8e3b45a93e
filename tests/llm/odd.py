"""Rows that every operator must take: nulls, empty and long texts, repeated rows, extra columns with clashing names."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, key string, score double, n_lines long, k1 long, text_key long, spans string"
LONG = "lorem " * 30_000 + "ipsum\n" * 2_000 + "x" * 50_000
TEXTS = [
    (1, "One two three four five six seven eight nine ten."),
    (2, None),
    (3, ""),
    (4, " \n\t\n"),
    (None, "One two three four five six seven eight nine ten."),
    (None, None),
    (5, LONG),
    (6, "tie tie tie tie tie tie"),
    (6, "tie tie tie tie tie tie"),
    (6, "another text of the very same id"),
    (7, "...!?"),
    (8, "😀 émoji ÉCOLE 中文"),
    (9, "two words"),
    (10, "two words"),
]


def odd_documents(spark):
    rows = [(i, t, None if n % 5 == 0 else "en", None if n % 4 == 0 else f"s{n % 3}", None, "w", "k", 0.5, 7, 1, 2, "s") for n, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def small(spark, table="documents", sf="sf0.001"):
    return spark.read.parquet(f"/root/testdata/{sf}/{table}.parquet")


def texts(spark, values, sources=None):
    rows = [(i, t, "en", (sources or ["s"] * len(values))[i], len(t or "")) for i, t in enumerate(values)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def words_of(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def shingles_of(text, size=5):
    ws = words_of(text)
    return {tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def count(df):
    return df.agg(F.count("*")).first()[0]
