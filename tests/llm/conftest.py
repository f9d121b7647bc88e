import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the word of " * 20000 + "\n" + "a line that is long enough to count\n" * 50


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    base = [
        (1, "The Mit License is here.\nA shared line of some length\nshort", "en", "b", 10),
        (1, "The Mit License is here.\nA shared line of some length\nshort", "en", "b", 10),
        (2, "  a SHARED line of some length \t\nown text with other words in it", "en", "a", 5),
        (2, "another text that has the same number", "en", "a", 5),
        (None, "A shared line of some length", "en", None, None),
        (None, None, None, None, None),
        (3, None, "de", "a", None),
        (4, "", "de", None, 0),
        (5, " \t\n\v\f\r\n", None, "c", 7),
        (6, LONG, "en", "c", len(LONG)),
        (7, "één Été GNU général public LICENSE vK İx ſtop token = 'abcdef123456'", "fr", "c", 1),
        (8, "12345 67890 --- !!!", "en", "d", 1),
        (9, "x", "es", "d", 1),
    ]
    return base


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    """Sixty documents of the given table, as (doc_id, text, source), with near copies among them."""

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    return [r.asDict() for r in rows]
