import pytest


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) rows, with an extra column whose name operators use inside."""

    def build(rows, extra="fp long, key string"):
        names = "doc_id long, text string, lang string, source string, " + extra
        return spark.createDataFrame([(i, t, "en", None if i is None or i % 3 == 0 else f"s{i % 2}", 7, "x") for i, t in rows], names)

    return build
