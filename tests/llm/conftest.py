import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rnd, n, kinds=400):
    return [f"w{rnd.randrange(kinds)}" for _ in range(n)]


@pytest.fixture(scope="session")
def texts():
    """Odd and plain texts: null, empty, blank, signs of many scripts, special strings, copies, shared passages, one very long."""
    rnd = random.Random(5)
    passage = " ".join(words(rnd, 60, 10**6))
    out = [None, "", " \t\n", "a", "it's we're they'll '' 're", "é中 ½ １２ 　 x  y\r\n\n z", "<|endoftext|> a<|endoftext|>b", "Same Text here", "same text HERE"]
    out += [" ".join(words(rnd, rnd.randrange(1, 120))) for _ in range(40)]
    out += [" ".join(words(rnd, 30)) + "\n" + passage + "\n" + " ".join(words(rnd, 20)) for _ in range(6)]
    out += [out[15], out[15], out[20] + " tail"]
    out += [" ".join(words(rnd, 40)) + " " + "again and " * 60]
    out += [" ".join(words(rnd, 30_000, 5000))]
    return out


@pytest.fixture(scope="session")
def rows(texts):
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def clashing(spark):
    """A null doc_id, repeated rows, a tie and extra columns whose names clash with inner ones."""
    some = [(None, "one two three four", 1, 2, "x", 3), (7, "one two three four", 1, 2, "x", 3), (7, "one two three four", 1, 2, "x", 3), (8, None, 1, 2, "x", 3)]
    return spark.createDataFrame(some, "doc_id bigint, text string, block bigint, bucket int, payload string, print bigint")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
