"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns: every operator and stage has a defined result."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from factloom.llm import audio, bpe, feistel, infill, langid, line_dedup, lm, packing, pii, quality, scaled_sketch, simhash, variants
from factloom.llm.queries import queries

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LONG = "lorem ipsum dolor " * 20_000
ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", "b", 3), (4, "one", "en", None, 3), (4, "one", "en", None, 3), (None, "no id here at all", "en", "c", 17),
    (5, LONG, "en", "a", len(LONG)), (6, "漢字 🙂 é", None, "b", 6), (7, "***", "de", "c", 3), (8, "x" * 5000, "fr", "a", 5000), (9, "line\nline\n\nline", "en", "a", 15), (None, None, None, None, None),
]
#: Names that operators use inside or could.
EXTRA = ("h", "fp", "k", "key", "n", "u", "v", "ids", "words", "batch", "shard", "bucket", "site", "line", "root", "node", "size", "sketch", "quality", "score", "learned", "row_no", "first", "variant", "media", "held", "before", "at", "of", "cut", "keep", "left", "mine", "its_id", "its_hash", "told", "measured", "__hash", "__cut", "__keep", "__of", "__keys", "__left", "__quality", "__toxic", "__lang", "__kept", "__bucket", "keys", "__n", "tokens", "text_hash", "component_id", "n_rows", "low", "place", "h", "lot", "s", "d", "first_doc")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    out = {}
    for name, rows in (("edge", ROWS), ("none", [])):
        d = str(tmp_path_factory.mktemp(name))
        docs = spark.createDataFrame(rows, SCHEMA)
        for x in dict.fromkeys(EXTRA):
            docs = docs.withColumn(x, F.lit("clash"))
        docs.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(4, 1, 0), (5, 1, 0), (9, 0, None), (None, 1, 0)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        out[name] = d
    return out


@pytest.mark.parametrize("name", sorted(queries()))
@pytest.mark.parametrize("table", ["edge", "none"])
def test_query_on_edges(name, table, spark, tables):
    got = queries()[name](spark, tables[table]).collect()
    n = len(ROWS) if table == "edge" else 0
    if name.startswith("op1_"):
        assert sum(r["start"] == 0 for r in got) == n
    elif name.startswith("op12_"):
        assert not got  # no word of six letters occurs five times; the words by themselves are in test_variants.py
    else:
        assert len(got) == n
    if name.startswith("op6_") and n:
        assert {r["doc_id"]: r["lang_pred"] for r in got}[7] == "und"
    if name.startswith("op5_") and n:
        assert {r["component_id"] for r in got if r["fingerprint"] == "0" * 16} == {1}


@pytest.mark.parametrize("table", ["edge", "none"])
def test_stages_on_edges(table, spark, tables):
    docs = spark.read.parquet(f"{tables[table]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables[table])
        got = out.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            assert all(r[x] == "clash" for r in got for x in EXTRA)


def test_pipeline_runs(spark, tables):
    assert corpus_pipeline.run(spark, tables["edge"]).count() > 0
    assert corpus_pipeline.run(spark, tables["none"]).count() == 0


def test_modules_hold_queries():
    held = {f for m in (audio, bpe, feistel, infill, langid, line_dedup, lm, packing, pii, quality, scaled_sketch, simhash, variants) for f in dir(m) if f.startswith("op")}
    assert held == set(queries())


def test_nothing_else_imports_the_subpackage():
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(os.path.join(top, "factloom")):
        if os.sep + "llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    assert "factloom.llm" not in open(os.path.join(folder, n)).read()
