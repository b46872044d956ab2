import pytest

#: Columns with clashing names that every operator must leave alone.
EXTRA = "_id long, rank long, label string, part int, blob binary, n long, p double, size string"
TEXTS = ["", None, "   ", "a", "The quick brown fox jumps over the lazy dog.", "same text here for all of us", "same text here for all of us", "é à ü 中文 \U0001f600", "x " * 30000, "All rights reserved. CC BY 4.0"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and texts, extra columns whose names clash with those inside operators."""
    rows = [(i, t, None if i == 2 else "en", None if i in (3, 4) else f"s{i % 2}", len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id at all in this row", "en", "s0", 5), rows[4]]
    wide = [(*r, 7, 7, "L", 7, b"B", 7, 0.5, "big") for r in rows]
    return spark.createDataFrame(wide, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("1 = 0")
