import pytest

from texts import prose


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, ties, and columns whose
    names the operators use inside."""
    long = " ".join(prose(k) for k in range(400))
    rows = [(1, prose(1)), (2, prose(1)), (3, prose(2)), (3, prose(2)), (4, ""), (5, None), (6, "   \n\t"), (7, "one"), (8, long), (9, prose(3) + " token = abcdef123"), (10, prose(3)), (None, prose(4)), (None, prose(1))]
    schema = "doc_id long, text string, digest string, keep_id int, _row int, fp string, maybe boolean, n_chars long"
    return spark.createDataFrame([(i, t, "x", 0, 1, "y", True, len(t or "")) for i, t in rows], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
