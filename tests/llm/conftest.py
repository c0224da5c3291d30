import pytest

from gleanery.session import stored


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make


#: Names that the operators use inside, as columns of the input.
CLASHES = "key id n group doc text_sha256 marks position n_copies ids decoded kept size lead part row shard norm digest wanted_sha body_sha kept_id copy_no".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    base = " ".join(f"word{i}" for i in range(60))
    long = " ".join(f"w{i * 7919 % 5003}" for i in range(40_000))
    rows = [
        (1, base, "en", "a"),
        (2, base.upper(), "en", "a"),
        (3, base.replace(" ", "\n\t "), "en", None),
        (4, base + " tail", None, "a"),
        (5, None, "en", "b"),
        (6, "", "fr", "b"),
        (7, " \n\t ", "fr", "b"),
        (8, "one", "fr", "b"),
        (8, "one", "fr", "b"),
        (9, long, "en", "c"),
        (10, long + " end", "en", "c"),
        (None, "a text without an id", None, None),
        (None, base, None, None),
        (11, "é" * 300 + "😀" * 50, "fr", "c"),
        (12, "x" * 5000, "fr", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in CLASHES:
        df = df.selectExpr("*", f"'{name}' AS {name}")
    return stored(df, "odd_docs")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
