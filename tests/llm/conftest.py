from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use names like, with values that would be wrong.
CLASHES = ("size", "kept", "rep", "n_words", "h", "copies", "_copy", "_id", "_times", "score", "x", "taken", "v", "n", "label", "_t", "_g", "target", "component_id", "piece", "length", "host", "path", "text_")


def prose(r: random.Random, n: int) -> str:
    words = ["".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 3))) for _ in range(n)]
    lines, k = [], 0
    while k < n:
        m = r.randint(6, 14)
        lines.append(" ".join(words[k : k + m]).capitalize() + ".")
        k += m
    return "\n".join(lines)


def odd_documents() -> list[tuple]:
    """Nulls, empty and blank and very long texts, repeated rows and ids, a null id."""
    r = random.Random(5)
    long = prose(r, 30_000)
    base = prose(r, 120)
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t\r\x0b\x0c ", "en", None, 7), (4, "word", None, "a", 4), (5, long, "en", "a", 1), (6, base, "en", "a", 1), (6, base, "en", "a", 1), (7, base, "de", "", 1), (8, base + " " + prose(r, 5), "en", "ä", 1)]
    rows += [(9, "x" * 50_000, "en", "b", 1), (10, "one two three one two three", "en", "b", 1), (None, prose(r, 80), "en", "a", 1), (11, "<|endoftext|> \x1c \xa0naïve  \x01 don't", "en", "b", 1)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    df = spark.createDataFrame(odd_documents(), DOCUMENT)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENT)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
