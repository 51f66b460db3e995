"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["n_words", "kept", "blob", "spans", "score", "node", "root", "at", "group", "block", "bucket", "labels", "text_id", "gone_id", "found_blob"]

_draw = random.Random(11)
WORDS = [("".join(_draw.choices(["an", "the", "er", "in", "ou", "st"], k=_draw.randint(1, 4)))) for _ in range(400)]


def prose(n: int, seed: int) -> str:
    return " ".join(random.Random(seed).choices(WORDS, k=n))


LONG = prose(30_000, 1)
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", "a", 4),
    (4, "one two", "en", None, 7),
    (5, prose(60, 5), "en", "a", 1),
    (6, prose(60, 5), "en", "a", 1),
    (None, prose(60, 5), None, "a", 1),
    (7, prose(60, 7), "en", "a", 1),
    (7, prose(60, 7), "en", "a", 1),
    (7, prose(60, 8), "de", "a", 1),
    (8, LONG, "en", "hot", 1),
    (9, LONG[: len(LONG) // 2], "en", "hot", 1),
    (10, "é" * 700 + " ünï 日本語 \U0001d518", "fr", "hot", 1),
    (-3, "same words " * 50, "en", "hot", 1),
    (11, "12 345 67 !!! ---", "en", "hot", 1),
]


def table(spark, rows=ROWS, parts=3):
    """The rows as documents, with columns named like those the operators make."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, SCHEMA)
    return docs.withColumns({name: F.lit("clash") for name in CLASHES}).repartition(parts)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
