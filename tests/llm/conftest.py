import re

import pytest

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="session")
def words():
    return lambda text: SPACED.findall(lower(text))


@pytest.fixture(scope="session")
def plain_words():
    return lambda text: ALNUM.findall(lower(text))


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls, empty and long texts, repeats, ties and a clashing extra column."""
    import random

    rng = random.Random(5)
    vocab = ["Alpha", "beta", "gamma,", "delta.", "été", "naïve", "x1", "end"] + [f"w{i}" for i in range(60)]

    def text(n):
        return " ".join(rng.choice(vocab) for _ in range(n))

    base = text(200)
    rows = [(i, text(rng.randint(1, 80)), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, base.replace(" beta ", f" b{i} ", 1), "en", "s0") for i in range(12)]
    rows += [(200, None, None, None), (201, "", "en", "s1"), (202, " \t\n", "en", "s1"), (203, "one", "en", "s1"), (204, "one two", "de", None), (205, "one", "en", "s1")]
    rows += [(300, base, "en", "s2"), (300, base, "en", "s2"), (301, text(20000), "en", "s2"), (None, text(30), "en", "s0"), (-7, "minus seven", "en", "s0")]
    return spark.createDataFrame([(*r, len(r[1] or ""), 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, size int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
