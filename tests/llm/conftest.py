import random

import pytest

WORDS = [f"w{i}" for i in range(400)]


def passage(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text, lang, source) with near copies, exact copies, common passages, empty, null and very long texts."""
    rnd = random.Random(5)
    common = passage(rnd, 40)
    rows = []
    for i in range(120):
        rows.append(passage(rnd, rnd.randint(1, 90)))
    for i in range(12):
        base = passage(rnd, 80).split(" ")
        for _ in range(rnd.randint(2, 6)):
            own = list(base)
            for _ in range(rnd.randint(0, 4)):
                own[rnd.randrange(len(own))] = rnd.choice(WORDS)
            rows.append(" ".join(own))
    rows += [common + "\n" + passage(rnd, rnd.randint(5, 60)) for _ in range(40)]
    rows += [rows[3]] * 15 + [rows[3].upper()] * 2
    rows += ["", "", None, None, "   \n\t ", "one", "ONE", "two words", "a b c d", "a b c d e", "stop <|endoftext|> go", passage(rnd, 20000), "é É \U0001f600 ü\n\n x'll 12"]
    return [(i, t, ["en", "de", None][i % 3], f"src{i % 7}" if i % 11 else None) for i, t in enumerate(rows)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string")
    # clashing further columns
    for name in ("n", "key", "shard", "bucket", "score", "component_id", "f1"):
        df = df.withColumn(name, df.doc_id * 0 - 1)
    return df.repartition(5).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
