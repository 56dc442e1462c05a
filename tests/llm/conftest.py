import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, blanks, nulls and a very long one, as (doc_id, text)."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 8))) for _ in range(300)]

    def words(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    passage = words(60)
    texts = [None, "", "   \t\n", "one", "two words", "one", "ONE", None]
    for _ in range(25):
        base = words(rng.randrange(5, 160))
        texts.append(" ".join(base))
        if rng.random() < 0.4:
            texts.append(" ".join(base))
        if rng.random() < 0.5:
            near = list(base)
            near[rng.randrange(len(near))] = "changed"
            texts.append("  ".join(near).upper())
        if rng.random() < 0.4:
            texts.append(" ".join(words(20) + passage + words(rng.randrange(30))))
    texts.append("\n".join([" ".join(passage)] * 3))
    texts.append("ab " * 300)
    texts.append(" ".join(words(6000)))
    texts.append("x" * 5000)
    ids = list(range(0, 3 * len(texts), 3))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.fixture
def docs(spark, corpus):
    """The corpus with one row twice."""
    return spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in [*corpus, corpus[9]]], SCHEMA).repartition(3)


@pytest.fixture
def rows(corpus):
    return [*corpus, corpus[9]]


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def clashing(spark):
    """Columns named like the operators' own, and null identifiers."""
    names = ["body", "keys", "rid", "k1", "tag", "n", "token", "sequence_id", "score", "removed", "h", "k"]
    values = [(1, "a b c d e f", *["q"] * len(names)), (None, "a b c d e f", *["q"] * len(names)), (None, None, *["q"] * len(names)), (4, " ".join("abcdefgh" * 9), *["q"] * len(names))]
    return spark.createDataFrame(values, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
