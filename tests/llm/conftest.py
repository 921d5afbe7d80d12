import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, row string, fp long, k1 string, host string, cell int"


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows that operators must survive: nulls everywhere, empty and long texts, repeats, and columns with clashing names."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdeéß", k=rng.randint(1, 7)))
    long = " ".join(word() for _ in range(30_000))
    texts = [None, "", " \n\t ", "one", "One two", "x " * 500, long, "line a\nLINE A\n\nline b", "same text here", "same text here", "ÄÖ ä b c", "a" * 5000, " z\x1cy"]
    rows = [(i, t, ["en", None][i % 2], ["s", None, ""][i % 3], len(t or ""), 1, "r", 2, "k", "h", 3) for i, t in enumerate(texts)]
    rows += [(None, "no id", "en", "s", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    rows += [rows[4], rows[4], rows[6]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
