from __future__ import annotations

import re

import pytest
from pyspark.sql import Row


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


#: Rows with every awkward case: nulls, empty and long texts, ties, repeats.
def awkward() -> list[tuple]:
    prose = "the cat sat on the mat and looked at the dog of the house for it was late in the day . " * 3
    return [
        (1, prose, "en", "a"), (2, None, "en", "b"), (3, "", None, None), (4, prose, None, "a"), (4, prose, None, "a"),
        (None, prose, "en", None), (None, None, None, None), (5, "x", "en", "é"), (6, "word " * 30_000, "de", "a"),
        (7, " \t\n", "fr", "b"), (8, "".join(chr(97 + i * 7919 % 26) for i in range(50_000)), "es", "b"), (9, "日本語 の 文", "ja", "c"),
        (10, "a b c d", "en", "c"), (11, "a b c d", "en", "c"), (12, "1234 !! ##", "en", "c"),
    ]


DOCS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def rows():
    return awkward()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The awkward rows, with extra columns whose names operators use themselves."""
    extra = "size int, label string, cls string, kept boolean, score double, row string, n_words int, target int, rid int"
    return spark.createDataFrame([(*r, 1, "l", "c", True, 0.5, "r", 3, 4, 5) for r in rows], f"{DOCS}, {extra}")


@pytest.fixture(scope="session")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


__all__ = ["Row", "words"]
