import pytest

CASES = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from all the others in the big dark wood", "en", "a", 1),
    (2, "the quick brown fox jumps over the lazy dog and runs far away from all the others in the big dark wood", "en", "a", 1),
    (3, None, "en", "a", None),
    (4, "", None, None, 0),
    (5, " \t\n ", "en", None, 5),
    (6, "one two", "de", "b", 7),
    (7, "One TWO", "de", "b", 7),
    (8, "wort " * 30_000, "de", "b", 3),
    (9, "a\n" * 40 + "b", None, "b", 3),
    (9, "a\n" * 40 + "b", None, "b", 3),
    (None, "one two", "de", "b", 7),
    (12, "é¿ ß漢字 " * 60, "zz", "c", 9),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rows = [(*r, "x", 1, 2) for r in CASES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n int, word string, k int".replace("n int", "n string").replace("word string", "word int")).cache()


SF = "/root/testdata/sf0.001"
