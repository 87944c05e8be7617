"""Rare languages keep their share of the trusted sample and a threshold of their own."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from factloom.llm import quality


def _docs(spark):
    rnd = random.Random(1)
    lang = ["en"] * 3000 + ["de"] * 240 + ["is"] * 20
    rows = [(i, " ".join(f"{k}{rnd.randrange(50)}" for _ in range(30)), k) for i, k in enumerate(lang)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id long, quality int, toxic int")


def test_rare_languages_are_sampled(spark):
    docs, judged = _docs(spark)
    drawn = {r["lang"]: r["n"] for r in quality.trusted(docs, judged, 600).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert drawn == {"en": 340, "de": 240, "is": 20}
    model = quality.train(docs, judged, 600)
    assert {"en", "de", None} <= set(model.by_lang)


def test_shares():
    assert quality._share({3000: 1, 240: 1, 20: 1}, 600) == 340
    assert quality._share({5: 4}, 100) == 5 and quality._share({}, 9) == 1 and quality._share({1000: 50}, 10) == 1
