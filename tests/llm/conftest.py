from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("rank", T.StringType())])
LONG = " ".join(f"w{i % 977}x{i % 1013}" for i in range(30_000))


def make(spark, rows):
    """Documents with extra columns whose names operators use themselves."""
    full = [(i, t, "en", s, len(t or ""), f"k{i}", "r") for i, t, s in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture
def odd(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, equal texts."""
    words = "the quick brown fox jumps over the lazy dog near the river bank today".split()
    near = " ".join(words * 4)
    rows = [(1, near, "a"), (2, near, "a"), (2, near, "a"), (3, None, None), (4, "", "b"), (5, "   \n", "b"), (6, LONG, "a"), (7, LONG + " end", "c"), (None, "no id at all here now", "a"), (None, near, "a"), (8, "one", None), (9, "One", "c"), (10, "é ü 漢字 <|endoftext|>", "a")]
    return make(spark, rows)


@pytest.fixture
def empty(spark):
    return make(spark, [])
