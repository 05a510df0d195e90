import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def corpus(seed=1, n=60):
    """Small texts with copies, near copies, shared passages, repeated lines, nulls and odd characters."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéß日") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage, line = say(70), say(14)
    out = []
    for i in range(n):
        kind = i % 10
        text = say(rng.randint(20, 200))
        if kind == 1:
            text = f"{say(20)}\n{passage}\n{say(15)}"
        elif kind == 2 and out:
            text = rng.choice(out) or ""
        elif kind == 3 and out:
            words = (rng.choice(out) or "x").split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif kind == 4:
            text = f"{line}\n{say(12)}\n{line}\n\n{say(30)}\t{say(3)}"
        elif kind == 5:
            text = rng.choice([None, "", "  \n ", "a", "a b", "<s> [INST] x </s>", "x" * 5000, "  " + say(3), "# * $ % |" * 9, "TOP " * 80])
        out.append(text)
    return [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(out)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
