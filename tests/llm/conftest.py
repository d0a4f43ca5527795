import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["held", "label", "kept", "lost", "size", "copies", "h", "k", "bits", "_doc", "text_hash", "_row", "shard", "low", "lines"]


def words(rng, n, pool=None):
    pool = pool or ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "mu", "nu", "xi", "pi", "rho", "tau"]
    return [rng.choice(pool) + str(rng.randrange(40)) for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    """Documents with exact and near copies, shared lines and passages."""
    rng = random.Random(7)
    out = []
    passage = " ".join(words(rng, 60))
    line = "This is a line that many documents hold, again and again."
    for i in range(40):
        w = words(rng, rng.randrange(5, 150))
        text = " ".join(w)
        if i % 4 == 1:
            text = text[: len(text) // 2] + "\n" + line + "\n" + text[len(text) // 2 :]
        if i % 5 == 2:
            text = text + " é " + passage + " ß " + " ".join(words(rng, 9))
        out.append((i, text, "en" if i % 2 else "de", f"s{i % 3}", len(text)))
    long = words(rng, 120)
    for j in range(6):  # near copies
        w = list(long)
        w[3 + j] = "changed"
        out.append((50 + j, " ".join(w), "en", "s0", 1))
    for j in range(5):  # exact copies
        out.append((60 + j, out[3][1], "en", None, 1))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and very long texts, repeated rows and ids, and columns that an operator might name so itself."""
    long = "word " * 30_000 + "end"
    rows = [
        (1, None, None, None),
        (2, "", "en", "a"),
        (2, "", "en", "a"),
        (None, "text without an id, but with some words in it", "en", "a"),
        (None, "text without an id, but with some words in it", "en", "a"),
        (None, None, None, None),
        (3, long, "en", "b"),
        (4, long, "en", "b"),
        (5, " \n\t\n ", "de", "b"),
        (6, "12345 67890 !!!", "de", "b"),
        (7, "one id, two texts: the first of the two", "de", "c"),
        (7, "one id, two texts: the second of the two", "de", None),
        (8, "\x00\x01 control é characters \U0001f600 and more of them", "fr", "c"),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    for c in CLASHES:
        df = df.selectExpr("*", f"'{c}' as {c}")
    return df


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
