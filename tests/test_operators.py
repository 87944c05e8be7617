"""Small cases with known answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factloom.functions import rules, semantics
from factloom.functions import text as x
from factloom.operators import graph, ledger, matching, measures, ordered
from factloom.plans.measures import word_error_rate
from factloom.plans.texts import joined_text
from factloom.sources import html, xlsx
from factloom.streaming import feeds


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_multiset_f1(spark):
    e = spark.createDataFrame([(1, t) for t in "aab"], "k int, w string")
    a = spark.createDataFrame([(1, t) for t in "abbc"], "k int, w string")
    r = measures.multiset(e, a, "k", "w").withColumn("f1", measures.f1(F.col("common"), F.col("expected"), F.col("actual"))).first()
    assert (r["common"], r["expected"], r["actual"]) == (2, 3, 4)
    assert r["f1"] == pytest.approx(4 / 7)


def test_error_rates(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("", "x"), ("", "")], "e string, a string")
    assert [r[0] for r in df.select(measures.char_error_rate(F.col("e"), F.col("a"))).collect()] == [0.5, 1.0, 0.0]
    assert word_error_rate("a b c d", "a x c") == 0.5
    assert word_error_rate("", "x") == 1.0


def test_wilson(spark):
    df = spark.createDataFrame([(0.99, i < 9) for i in range(10)] + [(1.0, True)], "s double, ok boolean")
    first = measures.wilson(df.where("s < 1"), "s", F.col("ok")).first()
    assert first["bin"] == 19 and first["confidence"] == pytest.approx(0.595844, abs=1e-5)
    assert measures.wilson(df.where("s = 1"), "s", F.col("ok")).first()["bin"] == 19


def test_stratified_fill(spark):
    df = spark.createDataFrame([(i, i < 10) for i in range(11)], "id int, positive boolean")
    got = measures.stratified_with_fill(df, F.col("positive"), F.col("id"), "s").collect()
    assert len(got) == 5 and sum(not r["positive"] for r in got) == 1


def test_gate_blocks_cycles_and_missing(spark):
    nodes = spark.createDataFrame([(i, True) for i in range(1, 7)] + [(7, False)], "id int, ok boolean")
    edges = spark.createDataFrame([(2, 1), (3, 4), (4, 3), (5, 99), (6, 7)], "src int, dst int")
    assert rows(graph.ready(nodes, edges, F.col("ok")), "id") == [(1,), (2,)]


def test_closure_with_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src int, dst int")
    got = rows(graph.closure(edges), "node", "reached", "depth")
    assert (1, 1, 3) in got and (1, 4, 3) in got and (3, 4, 1) in got and len(got) == 12
    assert graph.closure(edges.limit(0)).count() == 0


def test_three_way(spark):
    v = lambda *xs: spark.createDataFrame([("k", i, x) for i, x in enumerate(xs) if x != "-"], "a string, b int, value string")
    got = {r["b"]: (r["outcome"], r["value"], r["present"]) for r in graph.merge3(v("1", "1", "1", None), v("1", "2", "-", None), v("2", "3", "1", "-"), ["a", "b"]).collect()}
    assert got == {0: ("auto_incoming", "2", True), 1: ("conflict", "2", True), 2: ("auto_current", None, False), 3: ("auto_incoming", None, False)}


def test_matching():
    assert matching.largest_matching([(1, "a"), (1, "b"), (2, "a"), (3, "b")]) in ({1: "b", 2: "a"}, {1: "a", 3: "b"}, {2: "a", 3: "b"})
    assert matching.largest_matching([]) == {}


def test_islands_and_spans(spark):
    df = spark.createDataFrame([(1, p) for p in (4, 5, 6, 9)], "k int, page int")
    assert rows(ordered.islands(df, ["k"], "page"), "start", "end", "n") == [(4, 6, 3), (9, 9, 1)]
    spans = spark.createDataFrame([(1, 0, 5), (1, 3, 4), (1, 5, 8), (1, 10, 12)], "k int, start long, end long")
    assert rows(ordered.greedy_intervals(spans, "k"), "start", "end") == [(0, 5), (5, 8), (10, 12)]
    assert rows(ordered.merged_spans(spans, "k"), "start", "end") == [(0, 8), (10, 12)]
    whole = spark.createDataFrame([(1, 15), (2, 3)], "k int, length int")
    assert rows(ordered.residual_spans(whole, spans, "k"), "k", "start", "end") == [(1, 8, 10), (1, 12, 15), (2, 0, 3)]


def test_ranked(spark):
    df = spark.range(1000).withColumn("v", F.pmod(F.col("id") * 37, F.lit(1000)))
    got = ordered.ranked(df, [F.col("v")], "n").collect()
    assert all(r["n"] == r["v"] + 1 for r in got)


def test_semantics():
    got = semantics.language("The operator shall not")
    assert (got["language"], got["english"], got["confidence"], got["ambiguous"]) == ("en", 3.0, 1.0, False)
    kinds = lambda s: [m["kind"] for m in semantics.modalities(s)]
    assert kinds("It shall not run") == ["prohibition"] and kinds("It may run") == ["permission"] and kinds("Den kan stå") == ["permission"]
    assert kinds("before 3 May 2020 it must stop") == ["obligation"]
    t = semantics.thresholds("Carrier must ship at least 23 kg within 30 days.")
    assert [(m["operator"], m["value"], m["unit"]) for m in t] == [("gte", 23.0, "kg"), ("lte", 30.0, "days")]
    assert semantics.thresholds("at least one of the following") == []
    assert [(m["operator"], m["value"], m["end_value"]) for m in semantics.thresholds("between 5 and 10 kg")] == [("range", 5.0, 10.0)]
    assert [semantics.number(n) for n in ("1,000", "1,5", "ten")] == [None, 1.5, 10.0]
    text = "It must hold if dry, unless wet."
    assert all(text[c["start"] : c["end"]] == c["text"] for c in semantics.contexts(text))
    assert [c["mark"] for c in semantics.clauses("Keep: (a) one; (b) two")] == ["a", "b"] and semantics.clauses("no list") == []


def test_text_columns(spark):
    df = spark.createDataFrame([(" a \n b ", "1,000"), (None, "1,5"), ("", "ten")], "t string, n string")
    assert [r[0] for r in df.select(x.squeezed(F.col("t"))).collect()] == ["a b", "", ""]
    assert [r[0] for r in df.select(x.number(F.col("n"))).collect()] == [None, 1.5, 10.0]
    week = spark.sql("select timestamp '2024-01-07 23:30:00' as ts").select(x.week_of(F.col("ts"), "Europe/Oslo")).first()[0]
    assert str(week) == "2024-01-08"


def test_joined_text():
    assert joined_text("re-", "port") == "report"
    assert joined_text("see http://a-", "b") == "see http://a-b"
    assert joined_text("well-known-", "x") == "well-known-x"


def test_rules(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    assert rows(df.where(rules.compiled({"any": [{"field": "s", "op": "is_empty"}, {"field": "n", "op": "gt", "value": 5}]}, df.schema)), "n") == [(2,)]
    with pytest.raises(ValueError):
        rules.compiled({"field": "n", "op": "contains", "value": "x"}, df.schema)


def test_html():
    nodes = html.shred("<h1>T</h1><p>a<p>b<script>var x='<p>'</script><ul><li>1<li>2</ul>")
    assert [n["tag"] for n in nodes] == ["h1", "p", "p", "script", "ul", "li", "li"]
    assert nodes[3]["hidden"] and not nodes[1]["hidden"] and nodes[5]["section"] == 0
    assert html.shred(None) == [] and html.shred("") == []
    placed, issues = html.grid([(0, "a", 2, 1), (0, "b", 1, 1), (1, "c", 1, 1), (1, "d", None, 1)], 2)
    assert [p[:3] for p in placed] == [("a", 0, 0), ("b", 0, 1), ("c", 1, 1), ("d", 1, 2)] and issues == ["span:d"]


def test_xlsx():
    cells = list(xlsx.cells(xlsx.workbook({"A&B": [["x<y", None, "=C1*2"]]})))
    assert [(c["sheet"], c["coordinate"], c["value"], c["formula"], c["cache_status"]) for c in cells] == [("A&B", "A1", "x<y", None, "literal"), ("A&B", "C1", None, "C1*2", "missing")]
    assert xlsx.place("AB12") == (12, 28)


def test_feed_and_receipts(spark):
    log = spark.range(1, 1003).withColumnRenamed("id", "seq")
    page = ledger.feed_page(log, 0, 1000).collect()
    assert len(page) == 1000 and page[0]["has_more"] and page[0]["next_cursor"] == 1000
    assert not ledger.feed_page(log, 1000, 1000).first()["has_more"]
    r = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("a", "y", 3)], "id string, digest string, seq int")
    assert [v[1] for v in rows(ledger.receipts(r, ["seq"]), "seq", "outcome")] == ["applied", "replay", "conflict"]


def test_job_machine():
    assert feeds.advance("", 0, 0, ["queued", "running", "done"]) == ("done", 0, 0)
    assert feeds.advance("", 0, 0, ["running"]) == ("", 0, 1)
    assert feeds.advance("failed", 3, 0, ["queued"]) == ("failed", 3, 1)


def test_stream_counts(spark, sf_dir, tmp_path):
    path = f"{sf_dir}/event[s].parquet"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = feeds.counted(feeds.event_stream(spark, path, schema).withColumn("ts", F.col("ts").cast("timestamp")))
    got = feeds.run_once(stream, str(tmp_path), "complete")
    last = got.agg(F.max("batch")).first()[0]
    assert got.where(F.col("batch") == last).agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_stream_projection(spark, tmp_path):
    spark.createDataFrame([(1, 1, "queued"), (1, 2, "running"), (2, 3, "queued")], "item long, seq long, state string").write.parquet(f"{tmp_path}/in")
    events = feeds.event_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    feeds.projected(events, f"{tmp_path}/out", f"{tmp_path}/state").start().awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "item", "seq", "state") == [(1, 2, "running"), (2, 3, "queued")]
