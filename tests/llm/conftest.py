from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n: int, seed: int) -> str:
    """n words that follow from the seed, no five in a row alike in two seeds."""
    return " ".join(f"{WORDS[(seed * 7 + i * i + i) % 20]}{(seed * 31 + i * 17) % 997}" for i in range(n))


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, schema=SCHEMA):
        return spark.createDataFrame([(r + (None,) * 5)[:5] if schema == SCHEMA else r for r in rows], schema)
    return make


#: Null and empty texts, null ids, ties, rows that repeat, one long text.
ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "one two", "en", None), (None, prose(80, 1), "en", "a"),
    (5, prose(80, 2), "en", "b"), (5, prose(80, 2), "en", "b"), (6, prose(80, 2), "de", "b"), (7, prose(30_000, 3), "en", "b"), (8, "é ñ\n" * 60, None, "c"),
]


@pytest.fixture(scope="session")
def odd(frame):
    return frame(ODD)


@pytest.fixture(scope="session")
def clashing(spark, odd):
    """Extra columns with names that the operators use inside."""
    from pyspark.sql import functions as F

    names = ("row", "q", "key", "n", "w", "h", "k", "p", "size", "kept", "copies", "node", "text_", "start", "end", "spans", "item_id", "leaked", "target", "label", "base", "digest")
    return odd.withColumns({x: F.lit("x") for x in names})
