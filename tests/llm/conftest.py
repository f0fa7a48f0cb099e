import os

import pytest

SMALL = os.environ.get("VOXELITH_TEST_SF", "/root/testdata/sf0.001")

#: Rows that every operator must stand: nulls, empties, ties, repeats, odd characters, long texts.
ODD = [
    (1, None, "s"),
    (2, "", "s"),
    (3, " \t\n\x0b\x0c\r ", "s"),
    (4, "one", "s"),
    (5, "one two", None),
    (5, "one two", None),
    (6, "a b c a b c a b c", "s"),
    (7, "Line one\nLine two\nLine one\n\nLine two", "t"),
    (8, "mail x.y@z.example.com, a@b.c_d@e.f or 10.0.0.256 1.2.3.4.5.6.7.8 +1 (202) 555-0123.", "t"),
    (9, "4111 1111 1111 1111 and 4111-1111-1111-1112 and 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1", "t"),
    (10, "日本語 テスト 😀 é Ünïcode Σας <|endoftext|> it's", "t"),
    (11, "word " * 3000, "u"),
    (12, "x" * 20000, "u"),
    (13, "\x00\x01 nul", "u"),
    (None, "no id at all but some words to make a text", "u"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, source string").repartition(3).cache()


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")
