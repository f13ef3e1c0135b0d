import random

import pytest


def made_texts(n=60, seed=5):
    """Random texts with exact and near copies, shared passages, repeats, junk, nulls and empty texts."""
    r = random.Random(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"W{i}x" for i in range(300)]
    passage = " ".join(r.choice(words) for _ in range(55))
    out = []
    for i in range(n):
        text = " ".join(r.choice(words) for _ in range(r.choice([3, 18, 60, 150])))
        if i % 5 == 1 and out[-1]:
            text = out[-1]
        if i % 5 == 2 and out[-2]:
            text = out[-2] + " tail"
        if i % 6 == 3:
            text = text + "\n" + passage + "\n" + text[:40]
        if i % 11 == 7:
            text = "a b c d e f g h i j\n" * 9
        out.append(text)
    out[4], out[9], out[14] = None, "", " \t\n "
    out[20] = "one\x0btwo\x0cthree four"
    return out


@pytest.fixture(scope="session")
def texts():
    return made_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), i * 7, "x") for i, t in enumerate(texts)]
    # columns named like the operators' own
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, block long, rate string").repartition(3).cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows and ids, null texts."""
    t = " ".join(f"q{i}" for i in range(40))
    rows = [(None, t), (5, t), (5, t), (3, t + " more"), (5, "other words entirely " * 9), (None, None), (7, None), (8, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
