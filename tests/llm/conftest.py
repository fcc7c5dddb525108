"""Small corpora with the cases every operator must take: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1):
    """(doc_id, text) rows: copies, near copies, shared passages, an over-long text, nulls, blanks and a repeated row."""
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(20, 120), 400) for _ in range(25)]
    passage = words(rng, 60, 5000)
    texts = list(base)
    texts += [base[3], base[3], base[7].replace("w1", "W1"), base[5] + " tail", "x " + base[5]]
    texts += [f"{words(rng, 10)} {passage} {words(rng, 9)}" for _ in range(4)]
    texts += [words(rng, 4000, 900), "", "   \n\t ", None, "one", "two words", "é ü \U0001f600 ñ", "a" * 3000]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [rows[0], (None, base[3]), (None, None)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Documents with columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], SCHEMA)
    return df.withColumns({"fp": F.lit(1), "block": F.lit("x"), "component": F.lit(2), "kind": F.lit(3), "b": F.lit("b"), "guest": F.lit(0), "score": F.lit(0.5)})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
