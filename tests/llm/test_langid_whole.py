"""Language identification learns from all labelled documents, whole, in groups."""

from __future__ import annotations

import random

import numpy as np

from factloom.llm import langid


def _text(words: list[str], rnd: random.Random, n: int = 30) -> str:
    return " ".join(rnd.choices(words, k=n))


def test_groups_learn_from_all(spark):
    rnd = random.Random(3)
    words = {"aa": ["the", "cat", "dog", "house"], "bb": ["der", "hund", "katze", "haus"], "cc": ["zyx", "wvu", "qpo", "jkj"]}
    rows = [(i, _text(words[k], rnd), k) for i, k in enumerate(["aa"] * 300 + ["bb"] * 120 + ["cc"] * 40)]
    # a language whose only texts are longer than 64 KB
    rows += [(1000 + i, _text(["fjord", "sno", "vann"], rnd, 13_000), "dd") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.train(docs, 150)
    assert model.langs == ["aa", "bb", "cc", "dd"]
    assert [model.predict(x)[0] for x in ("the house cat", "der hund", "qpo jkj zyx", "vann sno fjord")] == model.langs
    again = langid.train(docs.repartition(7), 150)
    assert np.array_equal(model.logits, again.logits) and (model.temperature, model.threshold, model.noise) == (again.temperature, again.threshold, again.noise)
