from __future__ import annotations

import pytest

TEXT = "the quick brown fox jumps over the lazy dog near the old river bank while seven wise owls watch the silent moon rise"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts (a run of marks too), ties, repeated rows, extra columns with clashing names."""
    rows = [
        (1, TEXT, "en", "a"), (1, TEXT, "en", "a"), (2, TEXT + " again", "en", "b"), (3, None, None, None), (4, "", "en", None), (5, " \t\n\x0b ", None, "a"), (None, TEXT, "fr", "c"),
        (6, "one two", "en", "a"), (7, "One  TWO", "en", "b"), (8, "x" * 300_000, "en", "a"), (9, (TEXT + " ") * 600, "en", "b"), (10, "é漢 \U0001f600 ▁ ñandú\r\nfin", "es", "c"), (11, "12345 !!! ???", "en", "c"), (12, "@." * 150_000, "en", "b"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("row", "uid", "size", "batch", "score", "label", "spans", "pieces", "digest", "held_out", "_row", "_at", "_due", "at", "place", "due", "a.b"):
        df = df.selectExpr("*", f"'x' as `{name}`")
    return df


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def path():
    return "/root/testdata/sf0.001"
