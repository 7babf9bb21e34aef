from __future__ import annotations

import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices("abcdefghiklmnoprstuvwy", k=rng.randint(2, 8))) for _ in range(n)]


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents-like table of (doc_id, text) rows, over several partitions."""
    def make(rows):
        full = [(i, t, "en", "s", len(t) if t else 0) for i, t in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, empty and blank texts, repeated rows, a very long text, and columns with clashing names."""
    rng = random.Random(5)
    long = " ".join(words(rng, 30_000)) + "\nlast line of the long text."
    rows = [(1, "One line of words here.\nAnother line of words there.", 0), (1, "One line of words here.\nAnother line of words there.", 1),
            (2, None, 0), (3, "", 0), (4, "   \n\t\n ", 0), (None, "A text without an id, but with words.", 0), (5, long, 0),
            (6, "é ü ñ 中文 😀 tab\there", 0), (7, "x", 0), (None, None, 0)]
    schema = ("doc_id bigint, text string, n_tokens int, start int, blob int, component int, kept int, key int, id int, "
              "payload int, digest int, kind int, item int, line_id int, quality int, target int, part int, first int")
    return spark.createDataFrame([(i, t, *([k] * 16)) for i, t, k in rows], schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
