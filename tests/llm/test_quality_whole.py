"""All trusted texts teach the quality model, whole and however many, and its batches agree with the model in one piece."""

from __future__ import annotations

import random

import numpy as np
import pytest

from factloom.llm import kneser_ney, quality


def _table(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choices(["Aa", "aa", *"bcdefgh"], k=rnd.randint(1, 40))), rnd.choice(["en", "de", None])) for i in range(300)]
    # the only text that has these words is longer than 16 KB
    long = "zebra quokka " * 2_000
    rows += [(900 + i, long, "en") for i in range(6)]
    docs = spark.createDataFrame([*rows, (990, None, "en"), (None, "aa b", "en"), (3, rows[3][1], "en")], "doc_id long, text string, lang string")
    judged = spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i, _, _ in rows if i % 3] + [(990, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, judged


@pytest.mark.parametrize("batch_bytes", [8 << 20, 4_000])
def test_batches_agree_with_the_model_in_one_piece(batch_bytes, spark, monkeypatch):
    docs, judged = _table(spark)
    plain = kneser_ney.measured
    monkeypatch.setattr(kneser_ney, "measured", lambda *a: plain(*a, batch_bytes, 500))
    model = quality.train(docs, judged)
    assert b"zebra" in model.words
    got = quality.scored(docs, judged).collect()
    assert len(got) == docs.count()
    for r in got:
        p = -model.tokens(r["text"])
        z, t = model.excess(r["lang"], len(p), float(p.mean()))
        q = r["quality"]
        assert (q["n"], q["mean"], q["excess"], q["threshold"]) == pytest.approx((len(p), float(np.mean(p)), z, t), rel=1e-4, abs=1e-4)


def test_long_trusted_texts_are_learned(spark):
    docs, judged = _table(spark)
    by = {r["doc_id"]: r["quality"]["mean"] for r in quality.scored(docs, judged).collect()}
    assert by[901] < 0.05
