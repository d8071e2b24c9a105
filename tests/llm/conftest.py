from __future__ import annotations

import pytest
from pyspark.sql import functions as F

#: Names that the operators use inside or for results, and one that has to be quoted.
CLASHING = (
    "size", "score", "kept", "fp", "part", "words", "copies", "shard", "Lang_Pred", "Predicted", "a`b", "_k1", "node", "_id", "_size", "_n", "_sha", "_sha_of", "_n_of", "_words", "_copies", "_copy", "_score", "__score",
    "_told", "_weight", "_task", "_row", "row", "task", "nth", "of", "first", "name", "uid", "root", "sketch", "kept_id", "rows", "stays", "component_id", "copy", "m", "d", "k", "a.b", "slot",
)
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def table(spark):
    """Rows of (doc_id, text, lang, source) as a table of documents, with columns that clash with names of results."""

    def make(rows):
        full = [(*r, *(None,) * (4 - len(r)), len(r[1]) if r[1] else None) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        return df.select("*", *[F.lit("clash").alias(name) for name in CLASHING])

    return make


@pytest.fixture(scope="session")
def odd(table):
    """Nulls in every column, blank and empty texts, a very long text, repeated rows, ties, one long word."""
    long = " ".join(f"word{i % 997} and the{i % 13}" for i in range(20_000)) + "."
    rows = [
        (1, "The cat sat on the mat.", "en", "b"), (2, "The cat sat on the mat.", "en", "b"), (3, "The  cat\tsat on the mat. ", "en", "a"), (4, None, None, None), (5, "", "en", "a"),
        (6, " \t\r\n\x0b\x0c", "fr", "a"), (7, long, "en", "c"), (8, long, "en", None), (8, long, "en", None), (9, "x" * 5_000, "de", "c"), (10, "é日本語 \U0001f600 naïve", "fr", "b"),
        (None, "no id at all here", "en", "b"), (None, None, None, None), (11, "12345 !!! ???", "en", "a"), (12, "The cat sat on the hat.", "en", "b"),
    ]
    return table(rows)


@pytest.fixture(scope="session")
def none(table):
    return table([])
