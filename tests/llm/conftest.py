import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, key string, row_key string"


def make(spark, rows):
    """Documents with extra columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", "y", "z") for i, t, s in rows], SCHEMA)


ODD = [
    (1, None, "b"),
    (2, "", "b"),
    (3, "  \n\t ", None),
    (4, "same words in two rows of one text", "a"),
    (5, "same words in two rows of one text", "a"),
    (5, "same words in two rows of one text", "a"),
    (None, "no id here but some words to count", "b"),
    (6, "x" * 30_000, "c"),
    (7, "one  two\n three four 漢字 \U0001f600 'tis don't <s>", "c"),
    (8, "word " * 6_000, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    return make(spark, ODD)


@pytest.fixture(scope="session")
def none(spark):
    return make(spark, [])


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
