"""Small documents with every odd case, and brute-force parts that several tests share."""

from __future__ import annotations

import random

from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("size", T.StringType()),
    T.StructField("KEY", T.StringType()), T.StructField("row", T.StringType()),
])
WORDS = "the of and apple Berry CHERRY date, egg. été ß über naïve x1 42 foo-bar".split()


def some_text(r: random.Random, words: int) -> str:
    return "".join(r.choice(WORDS) + r.choice([" ", " ", " ", "  ", "\n", "\t"]) for _ in range(words))


def odd_rows(seed: int = 1, n: int = 40) -> list[tuple]:
    """Nulls, empty and blank texts, copies, case variants, a repeated row, a long text; columns with clashing names."""
    r = random.Random(seed)
    rows = [(i, some_text(r, r.randint(0, 90)), r.choice(["en", "de", None]), r.choice(["a", "b", "c", "é", None]), 1) for i in range(n)]
    rows += [(100, None, None, None, None), (101, "", "en", "a", 0), (102, " \n\t ", "en", "a", 4), (None, "no key", "en", "b", 6)]
    rows += [(103, rows[3][1], "en", "b", 1), (104, rows[3][1].upper() if rows[3][1].isascii() else rows[3][1], "en", "b", 1), (103, rows[3][1], "en", "b", 1)]
    rows += [(105, some_text(r, 4000), "en", "c", 1), (106, "z" * 5000, "xx", "c", 5000)]
    return [(*row, "size", "key", "row") for row in rows]


def frame(spark, rows: list[tuple]):
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


def lowered(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
