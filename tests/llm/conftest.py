import random

import pytest

WORDS = "the and of to wind water tide harbour vessel berth stone light bread paper green seven under over near hand".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 400)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, short and very long texts, exact copies, a repeated row, a null id; a clashing column."""
    long = prose(1, 30_000)
    base = prose(2, 300)
    near = base.split()
    near[150] = "changed"
    return [
        (1, None, "en"), (2, "", "fr"), (3, "  \n\t ", None), (4, "a", "en"), (5, "…—!?", "en"), (6, long, "en"), (7, base, "de"), (8, base, "de"),
        (9, " ".join(near), "de"), (9, " ".join(near), "de"), (None, prose(3, 40), "en"), (11, "Ünïcödé straße " * 30, "de"), (12, prose(4, 120), None),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, "doc_id bigint, text string, lang string")
    clash = ["Score", "node", "slot", "shard", "n_words", "items", "spans", "row", "hash", "class_id", "n_bytes", "sketch", "bucket", "size", "rid"]
    return df.select("*", *(F.lit("own").alias(c) for c in clash)).cache()


@pytest.fixture(scope="session")
def vocabularies():
    import public_tokenizers

    return {k: public_tokenizers.path(f"{k}.json") for k in ("byte_bpe_50k", "word_bpe_49k")}
