import random

import pytest


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}x" for _ in range(n)]


@pytest.fixture(scope="session")
def small_docs():
    """(doc_id, text, source): random texts, exact and near copies, shared passages, odd cases."""
    rng = random.Random(7)
    rows, base = [], []
    for i in range(60):
        base.append(words(rng, rng.randrange(30, 300)))
        rows.append((i, " ".join(base[-1])))
    for i in range(60, 75):
        rows.append((i, " ".join(base[i - 60])))
    for i in range(75, 110):  # near copies of all degrees
        w = list(base[i % 20])
        for _ in range(rng.randrange(1, 2 + len(w) // 8)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    passage = words(rng, 45)
    for i in range(110, 120):
        rows.append((i, " ".join(words(rng, 40) + passage + words(rng, 20))))
    rows += [
        (120, None), (121, ""), (122, " \n\t "), (123, "one"), (124, "ONE"), (125, "Two words"), (126, "two WORDS"), (127, "a b c d\x1c e"),
        (128, "  lead\n\nlines  \n\nlead\n\n"), (129, "x " * 5000), (130, "é ñ 漢字 😀 " * 30), (131, "same line here\nsame line here\nsame line here"), (132, "it's don't 'tis | & # * < > % $"),
    ]
    return [(i, t, None if i % 17 == 0 else f"src{i % 5}") for i, t in rows]


@pytest.fixture
def docs(spark, small_docs):
    """The fixture as a table with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", 1, 2.0, True) for r in small_docs], "doc_id long, text string, source string, n_chars long, rid string, n_words int, score double, label boolean").repartition(5)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, n_chars long, lang string")


@pytest.fixture
def odd_docs(spark):
    """Null ids and repeated rows."""
    text = " ".join(f"q{i}" for i in range(50))
    return spark.createDataFrame([(None, text, None), (None, None, "a"), (3, text, "a"), (3, text, "a"), (3, "other " + text, "b"), (1, text, "b")], "doc_id long, text string, source string")
