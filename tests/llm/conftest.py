import os

import pytest

SMALL = os.environ.get("SMALL_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    return SMALL


ODD = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, "   \n\t ", None, None, None),
    (4, "one two three four five six seven", "en", "a", 1),
    (4, "one two three four five six seven", "en", "a", 1),
    (5, "x" * 300_000, "en", "b", 2),
    (6, "word " * 60_000, None, "b", 2),
    (7, "Ünïcödé ТЕКСТ 漢字 🙂 text", "de", None, 3),
    (None, "a row without an id but with some words", "en", "b", 4),
]


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and very long texts, a repeated row, and extra columns with clashing names."""
    df = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.selectExpr("*", "1 as item_id", "'x' as item", "2 as n", "3 as key", "4 as component_id", "5 as score", "6 as fp", "7 as line", "8 as start")


@pytest.fixture
def empty(odd):
    return odd.where("false")
