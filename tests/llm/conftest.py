import pytest

#: Texts with the odd cases that every operator must take: nulls, blanks, repeats, one very long text.
ODD = [(1, "The quick brown fox jumps over the lazy dog.\nAnother line of words stands here."), (2, None), (3, ""), (4, " \t\n "), (5, "The quick brown fox jumps over the lazy dog.\nAnother line of words stands here."), (6, "x"), (7, "Été naïve, l'été d'ici — œuvre ﬁn   ΣΑΣ\r\nline two <|endoftext|> it's"), (8, "word " * 30_000), (9, "x")]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with odd texts and columns whose names clash with those of results."""
    rows = [(i, t, "en", "fp", 0, "n") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, fp string, component_id int, removed_lines string")


@pytest.fixture(scope="session")
def none(spark, odd):
    return odd.where("doc_id < 0")
