import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, size string, row string, label string, id string, group string, n string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def edges(spark):
    """Null, empty, blank, short and very long texts, nulls elsewhere, repeated rows, ties, clashing column names."""
    long = prose(1, 40_000)
    texts = [None, "", " \n\t ", "one", "a b", prose(2, 120), prose(2, 120), prose(3, 80) + "\n" + prose(4, 30), long, "ÄÖ ñ 日本語 текст", "<|endoftext|> x\x1cy"]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "host", None if t is None else len(t), *["x"] * 8) for i, t in enumerate(texts)]
    rows += [rows[5], (None, prose(5, 60), "en", "host", 1, *["x"] * 8), (None, None, None, None, None, *[None] * 8)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
