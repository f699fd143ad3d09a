import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, row_key string, score string, src string, word string"


@pytest.fixture(scope="session")
def documents(spark):
    """documents with columns whose names the operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", 0, "k", "r", "c", "x", "w") for i, t in rows], DOCS)

    return make


LONG = " ".join(f"word{k % 7919} and{k % 13}" for k in range(60_000))
#: Nulls, empty and very long texts, ties, repeated rows and ids.
ODD = [(1, "a b c d e"), (2, "A b C d e"), (2, "A b C d e"), (2, "other text of a repeated id"), (3, None), (4, ""), (5, " \t\n "), (None, "a b c d e"), (None, None), (-1, "x"), (6, LONG), (7, LONG), (8, "naïve Ünï 中文   “q” <|endoftext|> it's")]
