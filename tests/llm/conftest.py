"""Frames that every operator must stand."""

from __future__ import annotations

import pytest

LONG = " ".join(f"word{i % 977} and" for i in range(40_000))
TEXTS = [None, "", " ", "a", "A b c d e f", "A b c d e f", "Zoë über naïve ñandú", "Σίσυφος 漢字 😀", "mail me@example.com or +1 (555) 555-0100", LONG, LONG, "x " * 500]


@pytest.fixture
def odd(spark):
    """Nulls in every column, repeated rows, ties, a very long text, and columns with names that operators might use."""
    rows = [(i, t, None if i % 3 else "en", None if i % 4 else "s", None if t is None else len(t), i, "x", None, float(i)) for i, t in enumerate(TEXTS)]
    rows += [(5, TEXTS[5], "en", "s", 11, 0, "x", None, 0.0), (None, "no key", None, None, None, None, None, None, None), (None, "", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long, sha string, node string, n double")


@pytest.fixture
def empty(odd):
    return odd.limit(0)
