"""Small document tables with the odd cases that every operator must stand."""

from __future__ import annotations

import random

WORDS = "the of and river stone light under moves every quiet garden walks again over small bright".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, repeated rows, a very long text."""
    long = prose(99, 9_000)
    return [
        (1, None, "en", "a", 0),
        (2, "", "en", "b", 0),
        (3, " \n\t ", None, None, None),
        (4, "12 34 !!", "de", "a", 8),
        (None, "a text without an id", "en", "a", 20),
        (5, prose(5, 150), "en", "a", 1),
        (5, prose(5, 150), "en", "a", 1),
        (6, prose(5, 150) + " more", "en", None, 1),
        (7, "Übung macht den Meister – ça va, señor?", "de", "c", 1),
        (8, long, "en", "c", 1),
        (9, "one", "fr", "b", 3),
        (10, prose(10, 90), "en", "b", 1),
    ]


def frame(spark, rows, clash: bool = True):
    """The rows as documents, with extra columns named like internal ones."""
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        for name in ("node", "key", "root", "score", "size", "rank", "chunk", "row"):
            df = df.selectExpr("*", f"'x' AS {name}")
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
