import random

import pytest
from pyspark.sql import types as T

WORDS = "the of and river stone cloud der die und le la les el los que water light night morning".split()

#: Extra columns whose names the operators use inside.
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    *(T.StructField(n, T.LongType()) for n in ("n_chars", "u1", "u2", "fp", "row_hash", "component", "rank", "bucket")),
    *(T.StructField(n, T.StringType()) for n in ("rest", "spans", "letters", "kept", "ids", "part", "start", "length", "row")),
])


def make_texts():
    """Texts by id: nulls, empty ones, very long ones, copies, near copies, shared passages, odd characters."""
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(n))
    passage = prose(70)
    texts = {i: prose(rng.randint(1, 120)) for i in range(40)}
    texts |= {i: f"{prose(30)} {passage} {prose(20)}" for i in range(40, 52)}
    texts |= {i: texts[5] for i in range(52, 58)}
    texts |= {58: None, 59: "", 60: "   \n\t ", 61: "12 34 !!", 62: passage, 63: prose(30_000), 64: "ab" * 4000, 65: "x", 66: "İ ΣΑΣ é 日本 😀 don't  a\n b"}
    texts |= {67: "a b c " * 60, 68: texts[63] + " end", 69: " lead and trail ", 70: "<|im_end|> <|endoftext|>"}
    return texts


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with clashing columns; id 7 is there twice, and one row has no id."""
    langs = ["en", "de", "fr", None]
    rows = [(i, t, langs[i % 4], "src", 0, 1, 2, 3, 4, 5, 6, 7, *"abcdefghi") for i, t in texts.items()]
    rows += [rows[7], (None, "a row without an id", "en", None, *(None,) * 17)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def in_order(texts):
    """(id, text) of every row of ``docs``."""
    return [*texts.items(), (7, texts[7]), (None, "a row without an id")]
