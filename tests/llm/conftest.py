from __future__ import annotations

import pytest


@pytest.fixture
def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows, clashing columns."""
    rows = [
        (1, "one two three four five six seven", "en", "a", 33, "x"),
        (2, None, None, None, None, None),
        (3, "", "en", "a", 0, "x"),
        (None, "null id here with some words", "en", "a", 5, "x"),
        (4, "One two three four five six seven", "en", "a", 33, "x"),
        (5, " \t\n ", "en", "a", 4, "x"),
        (6, "word " * 60_000, "en", "a", 300_000, "x"),
        (7, "call +1 (017) 555-7713 or mail bob.7@mail3.example.com", "en", "a", 50, "x"),
        (7, "call +1 (017) 555-7713 or mail bob.7@mail3.example.com", "en", "a", 50, "x"),
        (8, "单个 词语 \U0001f600 é", "zh", "b", 9, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string")


@pytest.fixture
def no_documents(odd_documents):
    return odd_documents.limit(0)
