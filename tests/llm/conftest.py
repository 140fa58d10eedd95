"""Small document tables."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "web", None if t is None else len(t)) for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, an empty, a blank and a long text, a repeated row, and further columns of clashing names."""
    long_text = " ".join(f"{chr(97 + i % 23) * 3}{chr(97 + i % 19)}ly runs" for i in range(60_000))
    rows = [
        (1, None, None, None, None), (None, "some words of no document at all", "en", None, None), (2, "", "en", "web", 0), (3, " \n\t ", "en", "web", 4),
        (4, long_text, "en", "web", len(long_text)), (5, "Equal rows stand here twice.", "en", "web", 28), (5, "Equal rows stand here twice.", "en", "web", 28), (None, None, None, None, None),
    ]
    extra = ["id", "a", "b", "h", "root", "node", "label", "rep", "list", "words", "lines", "t", "item_id", "gone_id", "row", "key", "start", "end", "quality"]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", *(f"'x' AS `{c}`" for c in extra))
