from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size int"
LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna "


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows, ties, a very long text, and clashing names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a", 5, "x", 1),
        (2, "the QUICK brown fox jumps over the lazy dog and runs away", "en", None, 5, "x", 1),
        (3, None, None, "b", None, None, None),
        (4, "", "en", "b", 0, "x", 1),
        (5, " \t\n ", None, "b", 4, "x", 1),
        (6, "two words", "en", "a", 9, "x", 1),
        (7, "!!! 123 ???", "en", "a", 11, "x", 1),
        (8, LONG * 300 + "é ▁ 😀", "de", "a", 1, "x", 1),
        (9, LONG * 300 + "é ▁ 😀", "de", "a", 1, "x", 1),
        (10, "two words", "en", "a", 9, "x", 1),
        (10, "two words", "en", "a", 9, "x", 1),
        (11, "une longue journée à la campagne française", "fr", "c", 1, "x", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session", autouse=True)
def _workers(spark):
    from exposia.llm.queries import prepare_workers

    prepare_workers(spark)
