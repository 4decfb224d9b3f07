import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with names of results."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "le", "la", "der", "die", "of", "the"]
    long = " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(6000))
    rows = [
        (1, None, "en", "a"),
        (2, "", None, "a"),
        (3, " \n\t ", "en", None),
        (4, long, "en", "a"),
        (5, long, "en", "a"),
        (5, long, "en", "a"),
        (6, "x" * 20000, "de", "b"),
        (7, "123 456 !!", "de", "b"),
        (8, "Ünïcode ǅ 漢字 שלום 🙂 é", "fr", "b"),
        (9, "one\x1ctwo\x85three four", "fr", "b"),
        (None, "a row without an id " * 20, None, None),
        (10, "same line\nsame line\nsame line\nother", "en", "c"),
    ]
    extra = [(i, t, lang, s, None if t is None else len(t), 9, "old", 0.5) for i, t, lang, s in rows]
    return spark.createDataFrame(extra, SCHEMA + ", n_words long, fingerprint string, score double")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
