import random

import pytest
from pyspark.sql import types as T


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    sounds = "an er th in on at is or it en ed es ar te".split()
    words = ["".join(r.choices(sounds, k=r.randint(1, 3))) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words)) + "."


#: ids and texts with a null id, null, empty and blank texts, repeated rows, copies, a very long text and a long word
EDGE = [
    (None, prose(1, 80)), (1, None), (2, ""), (3, " \n \t "), (4, prose(2, 30_000)), (5, prose(3, 120)), (5, prose(3, 120)), (6, prose(3, 120)),
    (7, prose(3, 119) + " end."), (8, "word"), (9, "word"), (10, "x" * 5_000), (11, "a  b\n\n\nc <|endoftext|> d\x00eé日"), (12, "one two three."),
]
CLASHES = ("key", "node", "bucket", "found", "content", "n_tokens", "table", "shard", "start", "lang_pred", "score", "words", "node_", "key_", "content_")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())]
                      + [T.StructField(c, T.StringType()) for c in CLASHES])


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame([(i, t, "en" if n % 2 else None) + ("?",) * len(CLASHES) for n, (i, t) in enumerate(EDGE)], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
