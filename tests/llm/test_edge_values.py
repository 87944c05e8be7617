"""What the operators give for null and empty texts, null ids, repeated rows and ties: values, not only counts."""

from __future__ import annotations

import hashlib
import math
import zlib

import pytest

from factloom.llm.queries import queries

ROWS = [(1, None, "en", "a"), (2, "", "en", "b"), (3, " \n\t", "en", None), (4, "one two", "en", "c"), (4, "one two", "en", "c"), (None, "no id", "en", "d"), (None, None, None, None), (6, "漢字 é", None, "e")]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("values"))
    spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) as n_chars").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def _rows(spark, table, name):
    return queries()[name](spark, table).collect()


def test_audio(spark, table):
    got = _rows(spark, table, "op2_audio_features")
    empty = [r for r in got if r["n_bytes"] == 0]
    assert len(empty) == 3 and {(r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in empty} == {(64, hashlib.sha256(bytes(64)).hexdigest(), zlib.crc32(bytes(64)))}
    assert len({(r["media_sha256"], r["feature"]) for r in empty}) == 1
    twice = [r for r in got if r["doc_id"] == 4]
    assert len(twice) == 2 and twice[0] == twice[1] and next(r for r in got if r["doc_id"] == 6)["n_bytes"] == len("漢字 é".encode())


def test_scores(spark, table):
    got = _rows(spark, table, "op3_backoff_automaton")
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 1), (0, 3), (1, 1), (2, 1), (3, 1), (4, 3), (4, 3), (6, 3)]
    assert len({r["train_tokens"] for r in got}) == 1 and all(math.isfinite(r["score"]) and r["score"] < 0 and r["n_known"] <= r["n_tokens"] for r in got)
    assert len({(r["base_score"], r["score"]) for r in got if r["n_tokens"] == 1}) == 1 and len({tuple(r) for r in got if r["doc_id"] == 4}) == 1


def test_fingerprints(spark, table):
    got = _rows(spark, table, "op4_scaled_sketch")
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in got) == [(0, 0), (0, 5), (1, 0), (2, 0), (3, 3), (4, 7), (4, 7), (6, 4)]
    by = {}
    for (text, r) in ((dict((i, t) for i, t, *_ in ROWS).get(r["doc_id"]), r) for r in got if r["doc_id"] is not None):
        by.setdefault(text or "", set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by.values()) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_lines(spark, table):
    got = _rows(spark, table, "op8_line_dedup")
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["n_lines"], r["n_removed"]) for r in got) == sorted((i or 0, t or "", 0 if t is None else t.count("\n") + 1, 0) for i, t, *_ in ROWS)


def test_quality(spark, table):
    got = _rows(spark, table, "op9_kneser_ney_quality")
    assert len(got) == len(ROWS) and all(r["keep"] for r in got if not (r["n_tokens"] or 0) > 1) and len({tuple(r) for r in got if r["doc_id"] == 4}) == 1


def test_new_operators(spark, table):
    fim = {(r["doc_id"], r["n"], r["form"]) for r in _rows(spark, table, "op11_fill_in_middle") if r["doc_id"] in (1, 2)}
    assert fim == {(1, 0, "plain"), (2, 0, "plain")}
    blank = [r for r in _rows(spark, table, "op13_personal_data") if r["doc_id"] in (1, 2)]
    assert {(r["n_email"], r["base_sha256"], r["spans"]) for r in blank} == {(0, hashlib.sha256(b"").hexdigest(), "")}
    assert _rows(spark, table, "op12_spelling_variants") == []
