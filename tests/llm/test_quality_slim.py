"""The query of op9 does not write texts that it does not return."""

from __future__ import annotations

from factloom.llm import quality


def test_texts_are_not_written(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b c " * (i + 1), "en") for i in range(20)], "doc_id long, text string, lang string")
    judged = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    seen, plain = {}, quality.written
    monkeypatch.setattr(quality, "written", lambda df, label, *a: seen.update({label: df.columns}) or plain(df, label, *a))
    monkeypatch.setattr(quality, "documents", lambda *_: docs)
    monkeypatch.setattr(quality, "labels", lambda *_: judged)
    assert quality.op9_kneser_ney_quality(spark, "").count() == 20
    assert "text" not in seen["measured"] and "doc_id" in seen["measured"]
