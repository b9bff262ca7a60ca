import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, sig long, part int"


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, repeated rows, nulls, empty and long ones; columns with clashing names."""
    r = random.Random(5)
    word = lambda: "".join(r.choice(["th", "an", "er", "é", "ion", "a"]) for _ in range(r.randint(1, 4)))
    prose = lambda n: [word() for _ in range(n)]
    base, passage = prose(150), " ".join(prose(60))
    texts = [None, "", " \n ", "one two", "One two", "a b c d", " ".join(base), " ".join(base)]
    for k in range(12):
        own = list(base)
        for _ in range(1 + k % 3):
            own[r.randrange(len(own))] = word() + "x"
        texts.append(" ".join(own))
    texts += [" ".join(prose(80)) + " " + passage + " " + " ".join(prose(40)) for _ in range(10)]
    texts += [" ".join(prose(3000)), "line one is here\n" * 30, "the of the of " * 60, "tok <|endoftext|> it's, don't. ÉCOLE 12,345 ..., x\u0301"]
    texts += [" ".join(prose(n)) for n in range(1, 30)]
    rows = [(k, t, ["en", "fr", None][k % 3], ["s0", None][k % 2], len(t or ""), k, 1, 2) for k, t in enumerate(texts)]
    return rows + [rows[6], rows[-1], (None, " ".join(base), None, None, 1, 1, 1, 1)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
