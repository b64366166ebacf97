"""Small documents with the awkward cases that every operator has to take."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, item_id long"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(("the", "an", "er", "ti", "on", "re", "ou", "é", "ß")) for _ in range(rng.randint(1, 4))) for _ in range(n))


def thue_morse() -> tuple[str, str]:
    """Two different words of 1024 letters that a polynomial hash modulo 2**64 never tells apart."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="session")
def texts():
    long = prose(1, 3000)
    base = prose(2, 120)
    words = base.split(" ")
    near = " ".join([*words[:60], "changed", *words[61:]])
    out = {0: None, 1: "", 2: "  \n\t ", 3: "one", 4: "one two", 5: base, 6: base, 7: near, 8: long, 9: "Ünï code 　 x\r\n\r\n  y " + prose(3, 30), 10: "same line\nsame line\nsame line\n" + prose(4, 9), 11: "spam and eggs " * 40}
    return out | {20 + i: prose(100 + i, 60) for i in range(10)}


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With null columns, repeated rows and columns whose names clash with other tables'."""
    rows = [(i, t, None if i % 5 == 0 else "en", None if i == 3 else f"s{i % 3}", None if t is None else len(t), "x", i) for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
