import pytest
from pyspark.sql import types as T

#: documents with every odd case: null and empty texts, white space alone, repeated rows, a
#: null id, equal texts, a long text, and extra columns named like columns the operators make
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("row", T.StringType()),
                       T.StructField("digest", T.StringType()), T.StructField("size", T.StringType()), T.StructField("key", T.StringType()), T.StructField("batch", T.StringType())])

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))


def odd_rows():
    base = " ".join(f"t{i}" for i in range(100))
    near = " ".join(f"t{i}" if i != 50 else "other" for i in range(100))
    texts = [(0, None), (1, ""), (2, " \n\t "), (3, "One two"), (4, "one TWO"), (5, base), (6, near), (7, base), (8, LONG), (9, LONG + " end"),
             (10, f"alpha beta {PASSAGE} gamma"), (11, f"delta {PASSAGE} epsilon zeta"), (12, "naïve façade — “quoted” ÉTÉ 𝄞 ſ İ"), (12, "same id, other text"),
             (5, base), (None, base), (None, None), (13, "x " * 40), (14, "a\x1cb c\xa0d <|endoftext|> it's I'LL 12ab"), (-3, near)]
    return [(d, t, None if d == 3 else "en", None if d in (4, None) else f"s{(d or 0) % 4}", None, "r", "d", "z", "k", "b") for d, t in texts]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def few(spark):
    from tabulon.sources.tables import table
    return table(spark, "/root/testdata/sf0.001", "documents")


def words(text, lower=False):
    b = (text or "").encode()
    return (b.lower() if lower else b).split()
