import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(seed=3, n=60):
    """Invented texts: copies, near copies, shared passages, repeats, nulls, empties, and one long text."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéñß") for _ in range(r.randint(1, 7))) for _ in range(400)] + ["the", "and", "you", "of"] * 20
    text = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage = text(60)
    texts = [text(r.randint(1, 120)) for _ in range(n)]
    for k in range(0, n, 7):
        texts[k] = texts[(k + 3) % n]
    for k in range(2, n, 9):
        w = texts[(k + 1) % n].split()
        w[len(w) // 2] = "changed"
        texts[k] = " ".join(w)
    for k in range(4, n, 8):
        texts[k] = text(5) + " " + passage + "\n" + text(6)
    texts[5] = "ab " * 200
    texts[6] = (text(9) + "\n") * 12
    texts[8], texts[9], texts[10], texts[11] = None, "", " \t\n ", "x"
    texts[12] = text(6000)
    texts[13] = "日本 🙂 " * 40
    rows = [(k * 3 + 1, t, "en", None if k % 11 == 0 else f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
