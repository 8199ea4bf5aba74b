import pytest

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet").cache()


@pytest.fixture
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names the operators use themselves."""
    rows = [
        (1, "a b c d e f g h i j", 0.5, "x"), (1, "a b c d e f g h i j", 0.5, "x"), (1, "other text", None, None), (2, "", 1.0, "y"), (3, None, None, "z"),
        (None, "no id here", 2.0, "w"), (None, None, None, None), (4, "word " * 40000, 3.0, "long"), (5, "\n\n \t\n", 0.0, ""), (6, "x" * 50000, 0.0, "run"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, score double, _row string")
