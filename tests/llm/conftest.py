import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside; a table may have them too.
CLASH = ("doc", "rid", "data", "key", "size", "node", "copy", "kept", "score", "slice", "target", "h", "at", "of", "_w", "start", "line", "group", "bands", "hit", "copies_of", "html", "value")


def make(spark, rows, clash=False):
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("x") for c in CLASH})
    return df


def corpus(seed=0, n=60):
    """Texts with copies, near copies, shared passages, repeated words and lines, and odd cases."""
    rng = random.Random(seed)
    vocab = [f"w{i}é" if i % 7 == 0 else f"word{i}" for i in range(400)]
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passages = [say(rng.randint(25, 60)) for _ in range(4)]
    rows, texts = [], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.15 and texts:
            t = rng.choice(texts)
        elif kind < 0.35 and texts:
            w = rng.choice(texts).split(" ")
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            t = " ".join(w)
        elif kind < 0.6:
            t = f"{say(rng.randint(0, 40))}\n{rng.choice(passages)}\n{say(rng.randint(0, 40))}\n{rng.choice(passages)}"
        elif kind < 0.7:
            t = " ".join([rng.choice(vocab)] * rng.randint(15, 80))
        else:
            t = "\n".join(say(rng.randint(1, 60)) for _ in range(rng.randint(1, 4)))
        texts.append(t)
        rows.append((i, t, f"src{i % 3}"))
    rows += [(n, None, "src0"), (n + 1, "", None), (n + 2, " \t\n ", "src1"), (n + 3, "one", None), (n + 4, say(20), "src2"), (n + 5, "ß" * 60, "src1"), (n + 6, say(9000), "src0")]
    rows += [(n + 7, texts[0], "src0"), (n + 7, texts[0], "src0")]  # a repeated row
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return make(spark, rows, clash=True).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [(1, "x", "s")]).limit(0)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, one id with two texts, nulls in every column."""
    t = " ".join(f"a{i}" for i in range(60))
    return make(spark, [(None, t, None), (None, None, None), (5, t, "s"), (5, t + " more words", "s"), (6, t, None), (7, "", "s")])
