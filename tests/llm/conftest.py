import os

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session", autouse=True)
def worker_path(spark):
    """Python workers find the library from any folder."""
    spark.sparkContext.environment["PYTHONPATH"] = ROOT


# names that operators use inside
CLASHES = "fp", "score", "n_words", "matches", "copy", "rate", "shuffle_key", "hash", "seed", "node", "chunk", "_row_key", "_gone", "_copies", "_cdf", "_mixed", "_parts", "_of", "_spans", "_text"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns named as operators name theirs."""
    long = " ".join(f"w{i % 997} of{i % 13}" for i in range(10_000))
    rows = [
        (None, "a text without an identifier that nobody else has at all", "en", "s"),
        (1, None, "en", "s"),
        (2, "", "en", None),
        (3, " \n\t ", "en", "s"),
        (4, "one", "en", "s"),
        (5, long, "en", "s"),
        (6, "the same text in every way\nand a second line of it", "de", "t"),
        (6, "the same text in every way\nand a second line of it", "de", "t"),
        (7, "the same text in every way\nand a second line of it", "de", "t"),
        (8, "THE SAME text in every way\nand a second line of it", "de", "t"),
    ]
    extra = "".join(f", {c} int" for c in CLASHES)
    schema = f"doc_id long, text string, lang string, source string, n_chars long{extra}"
    return spark.createDataFrame([(*r, len(r[1] or ""), *range(len(CLASHES))) for r in rows], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
