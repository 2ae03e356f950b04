from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        # names that operators use themselves
        T.StructField("score", T.StringType()),
        T.StructField("spans", T.IntegerType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def documents(spark):
    """Make a documents table from texts or (id, text) pairs, with columns whose names clash with results."""

    def make(rows):
        pairs = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(rows)]
        return spark.createDataFrame([(i, t, None, "kept", 7, len(t or "")) for i, t in pairs], DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def labels(spark):
    def make(rows, value="toxic"):
        return spark.createDataFrame(rows, f"doc_id bigint, {value} int")

    return make
