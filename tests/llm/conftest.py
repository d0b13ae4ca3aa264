import random

import pytest

WORDS = ["the", "of", "and", "alpha", "beta", "gamma", "delta", "mit", "license", "apache", "cc", "by", "x1", "Ünder", "naïve", "漢字"]


@pytest.fixture
def texts():
    """Random texts with copies, near copies, odd white space, nulls, empty and long ones."""
    rnd = random.Random(5)
    base = [" ".join(rnd.choice(WORDS) + rnd.choice(["", "", str(rnd.randint(0, 40))]) for _ in range(rnd.randint(1, 60))) for _ in range(40)]
    out = [None, "", "   \n\t", "one", "one", "Two  words", "a" * 5000, " ".join(["long"] * 3000 + [f"w{i}" for i in range(3000)])]
    for text in base:
        out += [text] * rnd.choice([1, 1, 2, 4])
        if rnd.random() < 0.6:
            words = text.split()
            for _ in range(rnd.randint(1, 3)):
                words[rnd.randrange(len(words))] = rnd.choice(WORDS)
            out.append(" ".join(words) + rnd.choice(["", ".", "\n"]))
    rnd.shuffle(out)
    return out


@pytest.fixture
def docs(spark, texts):
    """The texts with ids and with columns whose names the operators use inside."""
    rows = [(i, t, "en", "src", i, None, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id long, node string, key string")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
