import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names clash with those the operators make themselves.
CLASHING = ("score", "part", "set_id", "piece", "length", "salt", "n_bytes", "digest", "words", "component_id")


@pytest.fixture(scope="session")
def corpus():
    """Nulls, empty and very long texts, ties, exact and near copies, common lines, odd characters."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = [None, "", " ", "\n\t", "a", "Ünï cödé \x85 x y z", "x " * 3, "A B c", "a b C", "1234 5678 !!!", "<|endoftext|> and 's it's"]
    common = " ".join(words(60))
    for _ in range(60):
        texts.append(" ".join(words(rng.randint(6, 120))))
    for _ in range(15):  # a passage that many share
        texts.append(" ".join(words(rng.randint(100, 200))) + "\n" + common + "\n" + " ".join(words(30)))
    base = words(150)
    for _ in range(25):  # near copies at many distances
        copy = base[:]
        for _ in range(rng.randint(0, 12)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    texts += [" ".join(base)] * 6 + [" ".join(base).upper()] * 2
    texts.append(" ".join(words(30_000)))
    texts.append("word " * 2000 + "x" * 30_000)
    return [(i, t, None if i % 17 == 0 else ("en", "fr")[i % 2], "src0" if i % 3 else None, len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus, SCHEMA).repartition(3)
    for name in CLASHING:
        df = df.withColumn(name, F.lit("clash"))
    return df.cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
