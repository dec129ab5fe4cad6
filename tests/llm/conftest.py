from __future__ import annotations

import random

import pytest

WORDS = "the of and with from river stone light garden winter letter music bread paper window silver morning shadow".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "er", "ing"]) for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sequence_id string, rank string, score string, copies string"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, empty, blank, long and repeated texts, repeated rows, and columns whose names operators use."""
    rng = random.Random(3)
    long = prose(rng, 30_000)
    texts = [None, "", " \n\t ", "one", "two words", "a b c d e", long, long, prose(rng, 40), prose(rng, 300), "x" * 5000, "é ñ 中文 🙂", "<|endoftext|> mid <|endoftext|>", "same line\nother\nsame line", "\n\n", "AKIA" + "A" * 30]
    rows = [(i, t, "en", "src0", len(t or ""), "q", "r", "s", "c") for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, "no id here at all", None, None, None, None, None, None, None), (99, prose(rng, 12), None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
