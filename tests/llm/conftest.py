"""Documents with every oddity the operators have to stand."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, code string, `score` string, spans int"

LONG = "wordy thing in a very long text number 7 " * 6_000


def odd_rows():
    same = "the same text appears in two rows of this table today"
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "s", 0),
        (3, " \n\t ", "en", "s", 4),
        (4, LONG, "en", "s", len(LONG)),
        (5, same, "en", "s", len(same)),
        (5, same, "en", "s", len(same)),
        (6, same, None, None, None),
        (None, same, "en", "s", 1),
        (7, "12345 !!! ???", "en", "s", 13),
        (8, "Grüße aus Köln, çà et là: 日本語 😀 <|endoftext|> ende", "de", "s", 10),
        (9, "don't we'll THEY'RE  I'd\n\nnew   lines 's", "en", "s", 30),
    ]
    return [(*r, 1, "c", "s", 2) for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
