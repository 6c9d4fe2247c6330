from __future__ import annotations

import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 997}" for i in range(60_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (3, "Der schnelle braune Fuchs springt über den faulen Hund am Ufer des Flusses", "de", None),
    (3, "Der schnelle braune Fuchs springt über den faulen Hund am Ufer des Flusses", "de", None),
    (4, None, "en", "b"),
    (5, "", None, "b"),
    (6, " \t\n", "en", None),
    (7, LONG, "en", "c"),
    (8, LONG, "en", "c"),
    (9, "12345 67890 !!!", None, "a"),
    (None, "a row without any number of its own", "en", "a"),
    (None, "a row without any number of its own", "en", "a"),
    (10, "x" * 300_000, "en", "a"),
    (11, "1" * 200_000, "en", "c"),
    (12, "one", "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, blanks, very long texts, ties and repeated rows, and extra columns of internal names."""
    docs = spark.createDataFrame(TEXTS, SCHEMA)
    for name in ("size", "key", "node", "fp", "bucket", "copies", "share", "target", "spans", "base", "_row", "_kept", "path", "v", "n_chars"):
        docs = docs.withColumn(name, F.lit(7).cast("long"))
    return docs


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
