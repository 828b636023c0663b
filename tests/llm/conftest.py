import random

import pytest


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): plain, copies, near copies, a shared passage and line, nulls, empties, odd white space, a very long text, repeated rows."""
    rng = random.Random(5)
    out = []
    for i in range(30):
        out.append((i, prose(rng, rng.randrange(30, 200))))
    base = prose(rng, 150)
    for i in range(30, 42):
        w = base.split()
        for _ in range(i - 30):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(99)}"
        out.append((i, " ".join(w)))
    passage = prose(rng, 60)
    for i in range(42, 56):
        out.append((i, f"{prose(rng, 25)}\n {passage} \n  Terms APPLY here\t\nterms apply here\n{prose(rng, 25)}"))
    out += [(60, None), (61, ""), (62, "  \n\t "), (63, "one two"), (64, "One  two"), (65, "a b c d"), (66, "Ünïcode ÀÉ ß\x85  x"), (67, "\x00 nul \x0b\x0c mix")]
    out += [(70, prose(rng, 60000, 5000)), (71, "again " * 300), (72, out[3][1]), (None, out[4][1]), (None, None), (5, out[5][1]), (5, out[5][1])]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with columns that clash with what operators add."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for c in ("n_words", "keep", "kept_text", "h1", "sequence_id", "offset", "shard", "_d", "_k", "rid", "token", "source"):
        df = df.selectExpr("*", f"'own' AS {c}")
    return df


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.filter("1 = 0")
