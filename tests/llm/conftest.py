import random

import pytest

#: Names that operators use inside; tables may have columns of the same names.
CLASHING = ("fp", "h", "block", "learn", "component_id", "score", "row", "label", "first", "leaks", "at", "kept", "__node")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def words(seed: int, n: int) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(1, 7))) for _ in range(n)]


def prose(seed: int, n: int) -> str:
    return " ".join(words(seed, n))


@pytest.fixture(scope="session")
def make_docs(spark):
    def build(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), *("x" for _ in CLASHING)) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


#: Nulls, empty and blank texts, repeated rows, a very long text, unusual characters.
HARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, prose(1, 30)), (4, prose(1, 30)), (5, prose(1, 30)), (None, prose(2, 20)), (None, None),
    (6, prose(3, 30_000)), (7, "a"), (8, "É ß\x1c x y \U0001f600 don't 12345"), (9, "x" * 5000), (10, "the " * 300),
]


@pytest.fixture(scope="session")
def hard(make_docs):
    return make_docs(HARD).repartition(3)


@pytest.fixture(scope="session")
def none(make_docs):
    return make_docs([]).limit(0)
