import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """A table of documents from (doc_id, text) pairs, with extra columns whose
    names clash with those that operators add."""

    def build(rows, columns="doc_id bigint, text string"):
        return spark.createDataFrame(
            [(*r, 9.0, "x", 7) for r in rows], f"{columns}, score double, `_text` string, node int"
        )

    return build
