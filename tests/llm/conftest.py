import random

import pytest

CLASHING = ("id", "s1", "words", "anchor", "fp", "found", "base", "score", "size", "h", "part", "_row")


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeghilmnorstuéñ") for _ in range(rng.randint(1, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list[tuple[int | None, str | None]]:
    """Random texts with copies, near copies, shared passages, repeats, empty, null and long ones, null ids and repeated rows."""
    rng = random.Random(7)
    passage, other = sentence(rng, 90), sentence(rng, 70)
    rows: list[tuple[int | None, str | None]] = [(0, None), (1, ""), (2, " \t\n"), (3, "a"), (4, "The " * 300), (5, "The " * 300), (6, "x" * 900), (7, None)]
    for k in range(10, 60):
        rows.append((k, sentence(rng, rng.randint(1, 140))))
    rows += [(60 + k, f"{sentence(rng, 20)} {passage} {sentence(rng, 15)}") for k in range(6)]
    rows += [(70 + k, f"{other} {sentence(rng, k)}\n{passage[: 350 + 25 * k]}") for k in range(6)]
    long = sentence(rng, 6000)
    rows += [(80, long), (81, long + " end"), (82, rows[20][1]), (83, rows[20][1]), (84, rows[21][1].upper()), (85, "漢字 " * 200), (86, "🙂🙂 " + sentence(rng, 3))]
    words = rows[22][1].split() + sentence(rng, 80).split()
    rows += [(90, " ".join(words)), (91, " ".join(w for i, w in enumerate(words) if i != 40)), (92, " ".join(words[:-1]))]
    return [*rows, rows[30], rows[30], (None, rows[31][1]), (None, None)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as a table with more columns, whose names operators might use themselves."""
    rows = [(i, t, ("en", "fr", None)[k % 3], "src", *("x",) * len(CLASHING)) for k, (i, t) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame(rows, schema).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
