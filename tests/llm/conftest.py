import pytest

#: All columns of documents and some whose names the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept int, nll string, ids string, key string, held int, fp string, weight string, label int"


def rows_of(texts, start=0):
    return [(start + i, t, "en", f"s{i % 3}", None if t is None else len(t), 1, "x", "y", "z", 2, "f", "w", 3) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = "the quick brown fox jumps over the lazy dog and " * 5000
    rows = rows_of(["some plain words here for all", None, "", "   \n\t ", long, "some plain words here for all", "x" * 30_000, "日本語のテキスト", "a b\x85c \U0001f600"])
    rows += [rows[0]] * 3 + [rows[2]]
    rows += [(None, "no id at all", None, None, None, None, None, None, None, None, None, None, None)] * 2
    rows += [(None,) * 13, (50, None, "en", None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (0, 1, 0), (1, 0, 0), (4, 1, 1), (None, 1, None), (5, None, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
