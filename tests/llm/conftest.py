import random

import pytest

EXTRA = "_id long, _tag long, _row string, size int, bucket int, sig long, score double, root long, pretoken string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text[, lang[, source]]), with more columns whose names the operators use inside."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, None,
                 1, 2, "x", 3, 4, 5, 0.5, 6, "y") for r in rows]
        return spark.createDataFrame(full, SCHEMA)
    return make


# null, empty and blank texts, a null id, repeated rows, one id with two texts, a long text, a NUL, marks of other scripts
ODD = [
    (None, "a b c d e f g h"), (1, None), (2, ""), (3, " \t\r\n "), (4, "one two three"), (4, "one two three"),
    (5, "left text " * 30), (5, "right text " * 30), (6, "word " * 20_000), (7, "a\0b     c‍"),
    (8, "日本語 テキスト मराठी"), (9, None), (None, None), (10, "UPPER lower UPPER lower UPPER"), (11, "\n\n\n"),
]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)


def words(random_: random.Random, n: int, vocabulary: int = 2000) -> str:
    return " ".join(f"w{random_.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def sf_small():
    return "/root/testdata/sf0.01"
