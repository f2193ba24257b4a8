import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, spans string, rank int, start int, th string, component string, score double"


def prose(rng, n):
    return " ".join(rng.choice(("alpha", "beta", "gamma", "delta", "eins", "zwei", "été", "ñandú", "stone", "river")) + rng.choice("abcdefgh") * rng.randint(0, 3) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty, short and very long texts, copies, near copies, repeated rows, null keys."""
    rng = random.Random(7)
    long_text = prose(rng, 30000)
    base = [prose(rng, rng.randint(40, 200)) for _ in range(30)]
    texts = ["", None, " \t\n", "one", "one two", "a " * 200, "x y " * 90, long_text, "é" * 50, base[0], base[0], base[1] + " tail", "İ ß ﬁ é", "\x1c odd\x1d space"]
    texts += base + [b.replace(" ", "\n", 1) for b in base[:3]] + [" ".join(b.split()[:60] + ["changed"] + b.split()[60:]) for b in base[:4]]
    texts += [" ".join(base[5].split()[:45]) + " " + b for b in base[6:9]]
    out = []
    for i, t in enumerate(texts):
        source = (None, "s1", "s2", "", "s10")[i % 5]
        out.append((i * 3, t, "en" if i % 2 else None, source, None if t is None else len(t), 5, "clash", 1, 2, "t", "c", 0.5))
    out.append(out[-1])
    out.append((None, base[2], None, None, None, None, None, None, None, None, None, None))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
