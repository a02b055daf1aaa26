import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, shard string, _row int"


def edge_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns named like the operators' own."""
    rng = random.Random(5)
    words = ["the", "of", "und", "der", "les", "eau", "Haus", "niño", "straße", "x"]
    rows = []
    for i in range(160):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 120)))
        rows.append((i, text, rng.choice(["en", "de", "fr", None]), rng.choice(["a", "b", "c", None]), len(text)))
    rows += [(200, None, None, None, None), (201, "", "en", "a", 0), (202, " \t\n ", None, "b", 4), (None, "the of und", "en", "c", 1), (None, None, None, None, None)]
    rows += [(203, "ABC def", "en", "a", 7), (204, "abc DEF", "en", "a", 7), (205, "ÀBC def", "fr", "a", 7), (206, "àbc def", "fr", "a", 7)]
    rows += [(207, "same row", "en", "b", 8)] * 3 + [(208, "the of und " * 9000, "en", "a", 99000), (209, "w" * 30000, "en", "b", 30000), (-5, "12 34 56", "en", "a", 8)]
    return [(*r, 1, "clash", 3) for r in rows]


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
