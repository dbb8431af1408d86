"""Small tables for the operators: odd rows that every operator must take."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, packed string"
LOREM = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey xray yankee zulu".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(LOREM) + r.choice(["", "s", "ed", "ing"]) for _ in range(n))


def odd_rows() -> list[tuple]:
    long = prose(1, 30_000)
    texts = [None, "", " \n\t ", "one", "one two three", prose(2, 80), prose(2, 80), prose(2, 79) + " changed", prose(3, 60) + "\n" + prose(4, 60), long, long + " tail", "é ß 한국어 😀 " * 20, "\n\n\n", "x" * 5000]
    return [(i, t, "en", None if i % 2 else "s", None if t is None else len(t), "extra") for i, t in enumerate(texts)] + [(5, prose(2, 80), "en", "s", 1, "again")]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, short, long, equal, near-equal, repeated and non-Latin texts, with a column that clashes."""
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(12)] + [(3, 0, 0), (99, None, None)], "doc_id long, quality int, toxic int")
