import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


ODD = "doc_id long, text string, lang string, source string, n_chars long, fp string, component_id string, line string, ids string, key string, nats string, keep string, place string, domain string, epoch string"


def odd_rows(text):
    """Nulls in every column, empty and long texts, repeated rows, and columns with clashing names."""
    more = ("x",) * 10
    return [
        (1, text, "en", "src1", 5, *more), (2, text, "en", "src1", 5, *more), (2, text, "en", "src1", 5, *more), (3, None, None, None, None, *[None] * 10), (4, "", "en", "src2", 0, *more),
        (None, text, "en", "src1", 5, *more), (5, "long " * 30_000, "en", "src2", 1, *more), (6, "x" * 50_000, "de", None, 1, *more), (7, " \n\t\n ", "en", "src1", 1, *more), (8, "été 漢字 🙂\x00\u2028end", "fr", "source without number", 1, *more),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows("One line of ordinary words here.\nAnother line of words."), ODD)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], ODD)
