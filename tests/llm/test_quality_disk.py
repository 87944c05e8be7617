"""Texts and what they ask for are shuffled in passes, so that no step holds much more than a part of them."""

from __future__ import annotations

import random

from factloom.llm import kneser_ney, quality


def _moved(spark) -> int:
    return int(spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite())


def test_no_step_shuffles_all_texts(spark, monkeypatch):
    rnd = random.Random(6)
    words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(3, 9))) for _ in range(20_000)]
    docs = spark.createDataFrame([(i, " ".join(rnd.choices(words, k=500)), "en") for i in range(400)], "doc_id long, text string, lang string")
    judged = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    steps, plain, measured, whole = [], kneser_ney.written, kneser_ney.measured, sum(len(r["text"]) for r in docs.collect())

    def written(df, *a, **b):
        before = _moved(spark)
        try:
            return plain(df, *a, **b)
        finally:
            steps.append((_moved(spark) - before) / whole)

    for module in (kneser_ney, quality):
        monkeypatch.setattr(module, "written", written)
    monkeypatch.setattr(kneser_ney, "measured", lambda *a: measured(*a, 40_000, 10_000))
    assert quality.scored(docs, judged, texts=False).count() == 400
    assert max(steps) < 1.2
