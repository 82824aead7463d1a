import pytest

ODD = [
    (1, "a b c d e", "en"),
    (1, "a b c d e", "en"),
    (2, "a b c d e", None),
    (3, None, "en"),
    (4, "", "de"),
    (5, " \n\t", "en"),
    (None, "a b c d e", "en"),
    (None, None, None),
    (6, "A b C d e", "en"),
    (7, "The cat sat.  On the mat,\n\nit’s été 你好!! 123", "en"),
    (8, "x", "en"),
    (9, "1 2 3 !", "en"),
    (10, "word " * 30_000 + "end", "en"),
    (11, "z" * 60_000, "en"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing names."""
    rows = [(i, t, l, "x", 0, None, "y", 1, "z", True, 0.5) for i, t, l in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row int, class string, key string, group int, hash string, kept boolean, score double")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.collect()}
