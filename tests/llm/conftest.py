import pytest

#: Nulls, empty and blank texts, ties and repeated rows, a very long text, and columns with names that operators use.
ODD = [
    (1, None, None),
    (2, "", "a"),
    (3, " \n\t ", "a"),
    (4, "one two three four", "b"),
    (5, "one  two\tthree\nfour", "b"),
    (5, "one  two\tthree\nfour", "b"),
    (6, "word " * 60_000, "b"),
    (None, "no id here", "a"),
    (8, "Ünïcödé 日本語 🙂 <|endoftext|> it's", ""),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(*r, "x", 0, "h", 1.5) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n string, score int, key string, `_n` double")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
