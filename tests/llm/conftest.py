"""Small tables with every awkward case, for all operators."""

import random

import pytest

#: Columns whose names operators use inside.
CLASHES = ("r1", "r2", "th", "words", "pos", "length", "fp", "start", "kept", "key", "shard", "bad_th", "label")


def _rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, shared = text(300), text(90)
    edited = base.split()
    edited[150] = "changed"
    rows = [
        (1, base), (2, base), (3, " ".join(edited)), (4, None), (5, ""), (6, " \n\t "), (7, "two words"),
        (8, text(120) + " " + shared + " " + text(40)), (9, text(60) + " " + shared + " " + text(120)),
        (10, "a" * 900), (11, "ab " * 400), (12, text(12000)), (13, "É" * 500), (14, "x\ud7ffy \U0001f600 z"),
        (15, text(50) + "\n" + text(30) + "\n" + text(50)), (None, text(80)), (None, text(80)),
        (16, "word " * 30), (17, "ALL CAPS " * 40), (18, "#$% " * 60), (1, base), (19, base.upper()),
    ]
    return rows + [(100 + i, text(rng.randint(1, 80))) for i in range(40)]


@pytest.fixture(scope="session")
def rows():
    return _rows()


@pytest.fixture(scope="session")
def schema():
    return "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHES)


@pytest.fixture(scope="session")
def docs(spark, rows, schema):
    return spark.createDataFrame([(*r, *(None if i % 3 else "x" for i in range(len(CLASHES)))) for r in rows], schema).repartition(3)


@pytest.fixture(scope="session")
def empty(spark, schema):
    return spark.createDataFrame([], schema)
