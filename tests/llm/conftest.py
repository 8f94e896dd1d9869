import pytest


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, "the first text of all", "en", "a", 1, 1, 2, 3), (1, "the first text of all", "en", "a", 1, 1, 2, 3),
            (1, "another text under one id", None, None, None, None, None, None), (2, None, "en", None, None, 1, 1, 1),
            (3, "", "fr", "b", 0, 1, 1, 1), (4, " \n\t ", "fr", "b", 0, 1, 1, 1), (None, "a text without an id", "en", "a", 3, 1, 1, 1),
            (None, None, None, None, None, None, None, None), (5, long, "en", "c", 9, 1, 1, 1), (6, long, "en", "c", 9, 1, 1, 1),
            (7, "x" * 200_000, "de", "c", 9, 1, 1, 1), (8, "É漢字🙂 ́ \x00 </s>[INST] <|endoftext|>", "zh", "c", 9, 1, 1, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids int, score int, mark int"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")
