import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def corpus(spark):
    """Makes documents from ``(id, text)`` pairs, with columns whose names the operators use themselves."""

    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("lang", T.StringType()),
            T.StructField("source", T.StringType()),
            T.StructField("n_chars", T.LongType()),
            T.StructField("fp", T.StringType()),
            T.StructField("key", T.StringType()),
            T.StructField("row", T.StringType()),
            T.StructField("words", T.StringType()),
        ]
    )

    def make(pairs, partitions=3):
        rows = [(i, t, None, "s", None if t is None else len(t), "x", "y", None, "z") for i, t in pairs]
        return spark.createDataFrame(rows, schema).repartition(partitions)

    return make


ODD = [
    (None, None),
    (None, "a text without an id that has some words"),
    (1, None),
    (2, ""),
    (3, " \n \n\t "),
    (4, "one"),
    (4, "one"),
    (4, "an other text of the same id with more words in it"),
    (5, "Ünï ñ ß 漢字 \U0001f600 words\r\nand\x0bmore  double  spaces "),
    (6, "word " * 3000),
    (7, "x" * 20000),
]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)
