import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, empty and long texts, repeated rows and columns whose names the operators use themselves."""
    long = " ".join(f"lorem{i % 977}x{i % 31}" for i in range(60_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 68, "x", 1.0),
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 68, "x", 1.0),
        (2, None, "en", None, None, None, None), (3, "", None, "a", 0, "", 0.0), (None, "der schnelle braune Fuchs springt", "de", "b", 33, "k", 2.0),
        (None, None, None, None, None, None, None), (5, long, "en", "b", len(long), "y", 3.0), (6, long.upper(), "en", "b", len(long), "y", 3.0),
        (7, "12 34 !! \t\n", "de", "b", 10, "y", 3.0), (8, "naïve café \U0001F600 日本", "fr", "c", 15, "y", 3.0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, label double")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
