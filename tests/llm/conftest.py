import random

import pytest


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Small documents with exact and near copies, shared passages, and awkward cases."""
    rng = random.Random(3)
    passage, base = words(rng, 80), words(rng, 150).split()
    out = [words(rng, rng.randint(1, 200)) for _ in range(40)]
    out += [words(rng, 30) + " " + passage + "\n" + words(rng, 30) for _ in range(6)]
    for k in range(8):
        copy = list(base)
        for _ in range(k // 2):
            copy[rng.randrange(len(copy))] = "changed%d" % rng.randrange(10**6)
        out.append(" ".join(copy))
    out += [" ".join(base)] * 3 + [None, "", " \t\n ", "one", "two words", "é à ü ñ 😀 " * 30, "a " * 3000, words(rng, 4000), "x" * 5000]
    return list(enumerate(out))


@pytest.fixture(scope="session")
def docs(spark, texts):
    return frame(spark, texts)


def frame(spark, rows):
    """documents with columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, "xx", "s", 1, "k", 7, "w") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, keys string, class long, score string")
