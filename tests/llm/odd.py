"""Rows that every operator must take: nulls, blanks, ties, repeats, long texts, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, n long, slot int, line string, bucket long, score double, _gone int"


def words(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(n))


def rows() -> list[tuple]:
    base = words(1, 120)
    edited = base.split()
    edited[50] = "changed"
    texts = [
        (1, base), (2, base), (2, base), (3, " ".join(edited)), (4, None), (5, ""), (6, " \t\n "), (7, "a b c"), (8, "A  B\nC"),
        (None, base), (9, "x" * 70_000), (10, words(2, 400) + "\n" + words(2, 400)), (11, "the " * 300), (12, words(3, 60_000)),
        (13, "é" * 60 + " 中文   " + base[:200]), (14, base[:49]), (15, base[:50]), (None, None),
    ]
    return [(i, t, None if i == 3 else "en", None if i in (2, 5) else f"src{(i or 0) % 3}", None, 1, 2, 3, "l", 4, 0.5, 7) for i, t in texts]


def documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), SCHEMA)


def pairs() -> list[tuple]:
    return [(r[0], r[1]) for r in rows()]
