"""Documents with nulls, empty and long texts, copies, ties and repeated rows."""

import random

import pytest

WORDS = ["stone", "river", "Cloud", "lamp", "the", "of", "and", "über", "été", "niño", "x1", "42", "it's", "don't", "end."]


def corpus(seed: int = 0, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    shared = say(60)
    rows = []
    for i in range(n):
        text = say(rng.randint(1, 120))
        if i % 5 == 0:
            text = f"{say(10)} {shared} {say(10)}"
        rows.append((1000 - 7 * i, text, f"s{i % 3}"))
    copy = rows[3][1]
    rows += [(i, copy, "hot") for i in range(20)]
    rows += [(30 + i, copy.upper(), "hot") for i in range(3)]
    rows += [(40 + i, copy + f" tail{i}", None) for i in range(6)]
    rows += [(50, None, "s0"), (51, "", "s1"), (52, "", None), (53, "word", "s1"), (54, "ab" * 400, "s2"), (55, say(9000), "s2"), (56, "日本語 テキスト İstanbul ﬁ <|endoftext|> e\u0301", "s2")]
    rows += [rows[1], rows[1], (rows[2][0], "another text of the same id", "s1"), (None, "no id at all", "s1"), (None, copy, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(corpus(), "doc_id long, text string, source string").repartition(5)
    extra = {"keep_id": F.lit(1), "shard_": F.lit("x"), "rank": F.lit(2), "n": F.lit(None).cast("int"), "_salt_": F.lit(0)}
    return frame.withColumns(extra)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")
