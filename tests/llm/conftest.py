import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Edge rows: nulls, empty and long texts, ties, repeated rows, clashing names."""
    rows = [
        (1, "The cat sat on the mat and looked at the moon all night long", "en", "a", 0),
        (2, "The cat sat on the mat and looked at the moon all night long", "en", "a", 0),
        (2, "The cat sat on the mat and looked at the moon all night long", "en", "a", 0),
        (3, "", "en", None, 0),
        (4, None, None, "b", 0),
        (5, "12 34 !!", "de", "b", 0),
        (6, "word " * 30_000, "en", "a", 0),
        (7, "a" * 50_000, "en", "a", 0),
        (None, "no id here but a text that is long enough to count", "en", "a", 0),
        (8, "Ärger über große Straßen und schöne Häuser in der Stadt am Fluss", "de", "b", 0),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_tokens int")
