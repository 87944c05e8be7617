"""What the automaton shuffles: texts once, and each pair of words once as an n-gram and as a context."""

from __future__ import annotations

import random

import pytest

from factloom.llm import lm


def _written(spark) -> int:
    return int(spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite())


@pytest.mark.parametrize("word", [None, "aa bb"])
def test_shuffle_is_small(word, spark):
    """Also where one pair of words is a large part of all."""
    rnd = random.Random(2)
    words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(3, 9))) for _ in range(20_000)]
    texts = [" ".join(f"{word} {x}" if word and i % 3 == 0 else x for i, x in enumerate(rnd.choices(words, k=1_500))) for _ in range(400)]
    docs = spark.createDataFrame(enumerate(texts), "doc_id long, text string").selectExpr("*", "doc_id % 10 > 0 AS learned")
    before = _written(spark)
    assert len(lm.scored(docs, 400_000).collect()) == 400
    moved = (_written(spark) - before) / sum(map(len, texts))
    assert moved < 3.2
