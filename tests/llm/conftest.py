from pathlib import Path

import pytest
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"
LONG = "alpha beta gamma delta " * 60_000  # 1.4 MB

# Texts no operator may stumble over. Ids repeat, with the same and with another text.
ODD = [
    (1, "one two three four five six seven eight nine ten eleven twelve", "a"),
    (1, "one two three four five six seven eight nine ten eleven twelve", "a"),
    (2, None, "a"),
    (3, "", None),
    (4, " \n\t ", "b"),
    (5, "word", None),
    (6, LONG, "b"),
    (7, "One TWO three four five six seven eight nine ten eleven twelve", "c"),
    (7, "quite another text of the same id", None),
    (8, "ünïcödé 文字 \U0001f600 fin.", "ß"),
    (None, "a row without an id", "a"),
    (None, None, None),
]


@pytest.fixture(scope="session")
def clash():
    """Extra columns named like those that operators use themselves."""
    return ["size", "key", "words", "copies", "score", "part", "node", "cluster", "component_id",
            "kept", "leader", "content", "shard", "ids", "_mixid", "template", "phrases", "n"]


@pytest.fixture
def odd(spark, clash):
    rows = [(*r, None, *range(len(clash))) for r in ODD]
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("lang", T.StringType()),
        *(T.StructField(c, T.LongType()) for c in clash)])
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def nothing(odd):
    return odd.limit(0)


@pytest.fixture
def table(spark):
    def read(name, sf=SMALL):
        return spark.read.parquet(str(Path(sf) / f"{name}.parquet"))
    return read


@pytest.fixture
def texts(table):
    return sorted((r.doc_id, r.text or "") for r in table("documents").collect())
