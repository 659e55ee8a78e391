import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

PLAIN = "The quick brown fox is in the garden and it looks at the old house by the river."
ODD = [
    (1, PLAIN), (2, PLAIN), (2, PLAIN), (3, PLAIN + " Today."), (None, "No id here, but a text."), (None, None), (None, "No id here, but a text."),
    (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "one two"), (9, "ÀÉ ß İ ΑΣ 'S don't x <|endoftext|>y\x1cz"),
    (10, "word " * 30_000), (11, "x" * 200_000), (12, "a@b.co " * 2_000), (13, "line\n" * 3_000), (14, "Tom has 3 apples.\n\n\nAnn has 5 kg."),
]


@pytest.fixture(scope="session")
def odd_rows():
    return ODD


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties and repeats, and columns with clashing names."""
    rows = [(i, t, None if n % 3 == 0 else f"s{n % 2}", "en", n, 1, "x", 7) for n, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, fp int, `hash` string, shard int")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
