import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, spans string, _m string, _spans string, lang_pred string, _kept string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, columns whose names operators use themselves."""
    rng = random.Random(7)
    words = "the of and river stone lamp quiet signal window harbour ledger copper".split()
    long = " ".join(rng.choice(words) for _ in range(40_000))
    texts = [None, "", " \n\t ", "one", "one two", long, long, "the river stone lamp quiet signal", "The RIVER stone lamp quiet signal", "\x00\x1cé中́ \U0001f600"]
    rows = [(i, t, None if i % 3 == 0 else "en", None, None, 1.5, 7, "x", "y", "z", "w", "k") for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, "no id", *[None] * 10)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
