"""Small tables with the odd cases that every operator has to stand."""

from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
LABELS = "doc_id bigint, quality int, toxic int"
BENCH = "item_id bigint, text string"
PAGES = "page_id bigint, url string, html string"

WORDS = "the river runs past old mills and quiet fields while birds sing over water near a stone bridge where children play".split()


def prose(seed: int, n: int = 120) -> str:
    """Repeatable text of n words, lines of 15."""
    words = [WORDS[(seed * 7 + i * i + i * seed) % len(WORDS)] + ("" if i % 4 else str((seed * 31 + i * 17) % 97)) for i in range(n)]
    return "\n".join(" ".join(words[i : i + 15]) for i in range(0, n, 15))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty, blank, repeated, tied and long texts, no letters."""
    long = " ".join(prose(i, 400) for i in range(40))
    return [
        (1, prose(1), "en", "a", 10),
        (1, prose(1), "en", "a", 10),  # a repeated row
        (2, prose(1), "en", "a", 10),  # an exact copy
        (3, prose(1) + " tail", "en", "b", 10),  # a near copy
        (4, prose(4), None, "b", None),
        (5, None, "en", None, 0),
        (6, "", None, None, 0),
        (7, " \n\t ", "fr", "b", 4),
        (None, prose(9), "fr", "a", 1),
        (None, None, None, None, None),
        (8, long, "en", "a", len(long)),
        (9, "123 !!! ###", "de", "a", 11),
        (10, "x" * 30000, "de", "c", 30000),
    ]


@pytest.fixture()
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], DOCS)
