import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, id int, _id string, a int"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Texts with copies, edits, repeats, empties, nulls, odd white space and one long text."""
    rng = random.Random(5)
    texts = [words(rng, rng.randint(1, 120)) for _ in range(40)]
    texts += texts[:6]
    for t in texts[:8]:
        w = t.split()
        for _ in range(2):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    shared = words(rng, 40)
    texts += [words(rng, 30) + "\n" + shared + "\n" + words(rng, 10) for _ in range(6)]
    texts += ["", None, " \t\n", "one", "One", "two words", "a b c d e f g h " * 20, "é ü ß — ñ \r\n x", "tail\n" * 30, words(rng, 6000)]
    out = [(i, t, "en", f"s{i % 4}" if i % 7 else None, 0, 1, "k", 2, "u", 3) for i, t in enumerate(texts)]
    return out + [out[3], out[12]]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
