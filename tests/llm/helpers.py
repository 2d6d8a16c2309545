"""Plain Python versions, and rows that are awkward for every operator."""

import random
import re

from pyspark.sql import types as T

ODD = [
    None, "", " ", "\n\n", "a", "A a", "a b c", "Same text here, twice.", "Same text here, twice.", "x" * 5000, "word " * 3000,
    "tab\tand\x0bother\x0cspace\r\nline", "nbsp is no space", "Ärger ÜBER Éclair", "日本語 テキスト", "a  b   c", "\x1c\x1d\x1e\x1f\x85 odd breaks",
]

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def frame(spark, texts, start=0):
    rows = [(start + i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def words(s):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(s or ""))


def space_words(s):
    return re.findall(r"[^\x20\x09-\x0D]+", s or "")


def prose(seed, n, vocabulary=40):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))
