"""Disk and memory of what is only needed meanwhile: tables that go, texts that are shuffled once, memory that workers give back."""

from __future__ import annotations

import os
import random
from urllib.parse import urlparse

import pyarrow as pa

from factloom.llm import quality, simhash
from factloom.llm.common import meanwhile, thrifty, written


def _folders(spark) -> set[str]:
    return {x for x in os.listdir(urlparse(spark.conf.get("spark.checkpoint.dir")).path) if x.startswith("factloom-")}


def _moved(spark) -> int:
    return int(spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite())


def test_tables_go_and_those_that_stay_stay(spark):
    before = _folders(spark)
    with meanwhile(spark):
        a = written(spark.range(10), "a")
        with meanwhile(spark):
            b = written(a.selectExpr("id + 1 AS id"), "b", stays=True)
            c = written(b, "c")
            assert c.count() == 10
        assert len(_folders(spark) - before) == 2
        d = written(b.selectExpr("id + 1 AS id"), "d", stays=True)
    assert len(_folders(spark) - before) == 1
    assert sorted(x.id for x in d.collect()) == list(range(2, 12))
    assert written(d, "e").count() == 10 and len(_folders(spark) - before) == 2


def test_near_duplicates_shuffle_texts_twice_and_leave_two_tables(spark):
    """Once to compare them and once to keep rows; null ids and repeated rows as before."""
    rnd = random.Random(3)
    texts = [" ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(600)) for _ in range(300)]
    rows = [(i, x) for i, x in enumerate(texts)] + [(None, texts[0]), (None, "only here, with a null id"), (None, "only here, with a null id"), (5, texts[5])]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string"), "docs")
    before, moved = _folders(spark), _moved(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = written(simhash.keep_one(docs), "kept")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert _moved(spark) - moved < 2.6 * sum(map(len, texts))
    assert len(_folders(spark) - before) == 3
    assert sorted(((r.doc_id is None, r.doc_id), r.text) for r in kept.collect()) == sorted([*(((False, i), x) for i, x in enumerate(texts)), ((True, None), "only here, with a null id")])


def test_quality_leaves_its_measures_alone(spark):
    docs = spark.createDataFrame([(i, f"w{i} is a word of {i % 7} others", "en") for i in range(60)], "doc_id long, text string, lang string")
    judged = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    before = _folders(spark)
    assert quality.scored(docs, judged).count() == 60
    assert len(_folders(spark) - before) == 2  # what is measured, and what sets thresholds


def test_thrifty_takes_one_table_or_two():
    a, b = pa.table({"x": [1]}), pa.table({"x": [2]})
    assert thrifty(lambda t: t)(a) is a
    assert thrifty(lambda t, u: u)(a, b) is b
