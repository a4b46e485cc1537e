import random

import pytest
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

SF = "/root/testdata/sf0.001"

DOCS = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
    StructField("source", StringType()), StructField("n_chars", LongType()),
    # Names that operators use themselves.
    StructField("score", DoubleType()), StructField("kept", StringType()), StructField("ids", StringType()),
    StructField("id", StringType()), StructField("set_key", StringType()), StructField("bytes", StringType()),
])


def words(seed, n):
    pick = random.Random(seed)
    return " ".join("".join(pick.choice("abcdefghijklmno") for _ in range(pick.randint(1, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and blank texts, very long ones, ties, repeated rows, marks outside the basic plane."""
    long = words(1, 30_000)
    return [
        (1, "plain words " + words(2, 80)), (1, "plain words " + words(2, 80)), (1, "same id, other text " + words(3, 60)),
        (None, "no id here " + words(4, 70)), (None, None), (5, None), (6, ""), (7, " \t\n "), (8, "short"),
        (9, long), (10, long + " end"), (11, "a" * 50_000), (12, "é\U0001f600 ñ ß " * 40), (13, "don't we'll I'd 's 're"),
        (14, "x\n" * 3000), (15, "   leading and trailing   "), (16, " 　wide spaces　"),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    rows = [(i, t, None, "s", None if t is None else len(t), 0.5, "k", "i", "x", "y", "z") for i, t in odd_texts]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
