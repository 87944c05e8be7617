"""Packages, exports, guards, catalogs, families, sketches and kept failures: planted cases and plain versions."""

from __future__ import annotations

import hashlib
import json
import random
import stat
import zipfile
from datetime import date
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from factloom.functions import rules
from factloom.operators import export, families, profiles, updates
from factloom.operators import ledger as l
from factloom.sources import packages
from factloom.streaming import failures

# ---- packages

FILES = {"a.txt": b"one", "b/c.txt": b"two"}


def _issues(raw):
    return sorted((p, i) for p, _, _, i, _ in packages.entries(raw) if i) if raw is not None else [(None, next(packages.entries(None))[3])]


def test_whole_packages():
    raw = packages.packed(FILES)
    assert raw == packages.packed(dict(reversed(FILES.items())))
    assert [(p, n, h, i, c) for p, n, h, i, c in packages.entries(raw)] == [(p, len(x), hashlib.sha256(x).hexdigest(), None, x) for p, x in sorted(FILES.items())]
    assert list(packages.entries(packages.packed({}))) == []


@pytest.mark.parametrize("path", ["/etc/x", "a\\b", "c:/x", "../x", "a/../b", "a//b", "./a", "", "a/", "con.txt", "x/LPT1", "a.", "b ", "a\nb", "a?b"])
def test_paths_that_are_refused(path):
    assert packages.path_issue(path)
    listed = {"files": [{"path": path, "size": 1, "sha256": hashlib.sha256(b"x").hexdigest()}]}
    assert [i for _, i in _issues(packages.packed({}, json.dumps(listed).encode()))][0].startswith("path_")


def test_broken_packages():
    good = {"files/a.txt": b"one", "files/b/c.txt": b"two"}
    listed = lambda *items: json.dumps({"files": list(items)}).encode()
    assert _issues(None) == [(None, "archive_empty")] and _issues(b"PK") == [(None, "archive_corrupt")] and _issues(packages.packed(FILES)[:80]) == [(None, "archive_corrupt")]
    assert _issues(packages.packed(FILES, b"")) == [(None, "manifest_missing")] and _issues(packages.packed(FILES, b"{")) == [(None, "manifest_unreadable")] and _issues(packages.packed(FILES, b'{"files": NaN}')) == [(None, "manifest_unreadable")]
    assert _issues(packages.packed(FILES, b'{"files": [{"path": "a", "path": "b"}]}')) == [(None, "manifest_repeated_key")] and _issues(packages.packed(FILES, b"[]")) == [(None, "manifest_shape")]
    assert sorted(map(str, _issues(packages.packed(FILES, listed({"path": "a.txt"})))))[:1] == [str(("a.txt", "entry_shape"))] and [i for *_, i, _ in packages.entries(packages.packed({}, listed(5)))] == ["entry_shape"]
    assert _issues(packages.packed(FILES, stored=good | {"files/a.txt": b"eno"})) == [("a.txt", "file_changed")] and _issues(packages.packed(FILES, stored=good | {"files/a.txt": b"longer"})) == [("a.txt", "file_changed")]
    assert _issues(packages.packed(FILES, stored={"files/a.txt": b"one"})) == [("b/c.txt", "file_missing")] and _issues(packages.packed(FILES, stored=good | {"x": b""})) == [("x", "unlisted")]
    assert _issues(packages.packed({"a": b"1", "A": b"2"})) == [("A", "path_collision"), ("a", "path_collision")] and _issues(packages.packed({"a": b"1", "a/b": b"2"})) == [("a", "path_collision"), ("a/b", "path_collision")]
    out = BytesIO(packages.packed({"l": b"target"}))
    raw = BytesIO()
    with zipfile.ZipFile(out) as a, zipfile.ZipFile(raw, "w") as b:
        for n in a.namelist():
            e = zipfile.ZipInfo(n)
            e.external_attr = (stat.S_IFLNK if n != packages.MANIFEST else stat.S_IFREG) << 16
            b.writestr(e, a.read(n))
    assert _issues(raw.getvalue()) == [("l", "not_a_file")]


def test_bounds_of_packages(monkeypatch):
    raw = packages.packed(FILES)
    for name, value, want in (("ARCHIVE_BYTES", 10, "archive_size"), ("FILES", 1, "file_count"), ("TOTAL_BYTES", 10, "total_size")):
        with monkeypatch.context() as m:
            m.setattr(packages, name, value)
            assert _issues(raw) == [(None, want)]
    monkeypatch.setattr(packages, "FILE_BYTES", 400)
    assert _issues(packages.packed({"a": b"x" * 401, "b": b""})) == [("a", "file_size")]


def test_packages_from_files(spark, tmp_path):
    (tmp_path / "good.zip").write_bytes(packages.packed(FILES))
    (tmp_path / "bad.zip").write_bytes(b"nothing")
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    got = {(r["package"].rpartition("/")[2], r["path"], r["issue"], bytes(r["content"]) if r["content"] is not None else None) for r in packages.read(files).collect()}
    assert got == {("good.zip", "a.txt", None, b"one"), ("good.zip", "b/c.txt", None, b"two"), ("bad.zip", None, "archive_corrupt", None)}


# ---- exports


def test_exports_write_what_has_changed(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    schema = "id string, v string"
    rows = [(f"k{i}", str(i)) for i in range(200)]
    table = lambda r: spark.createDataFrame(r, schema)
    back = lambda: sorted(map(tuple, export.exported(spark, path, schema).collect()))
    assert back() == [] and export.export(table(rows), path, "id", 16) == (1, 16) and back() == sorted(rows)
    assert export.export(table(rows[::-1]), path, "id", 16) == (1, 0)
    rows[7] = ("k7", None)
    assert export.export(table(rows), path, "id", 16) == (2, 1) and back() == sorted(rows, key=lambda r: (r[0], r[1] or ""))
    # broken off before its status: the version is not seen, and written anew
    kept = [r for r in rows if r[0] != "k8"]
    dealt = export.parts_of(table(kept[:20]), "id", 16)
    dealt.write.partitionBy("part").parquet(f"{path}/version=3")
    assert len(back()) == 200
    version, n = export.export(table(kept), path, "id", 16)
    assert (version, n) == (3, 1) and back() == sorted(kept, key=lambda r: (r[0], r[1] or "")) and export.status(spark, path)[0] == 3
    one = [r for r in kept if hash(r) is not None][:1]
    assert export.export(table(one), path, "id", 16)[0] == 4 and back() == one
    assert export.export(table([]), path, "id", 16) == (5, 0) and back() == []
    names = [r[0] for r in spark.createDataFrame([(1, 1, False), (1, 2, False), (1, 1, True)], "a int, b int, f boolean").select(export.state(F.col("a"), F.col("b"), F.col("f"))).collect()]
    assert names == ["current", "pending", "failed"]


# ---- guards and catalogs


def test_refused_updates_raise_nothing(spark):
    rows = [("a", 1, 0, "x"), ("a", 2, 0, "y"), ("a", 3, 0, "y"), ("a", 4, 1, "z"), ("a", 5, 3, "w"), ("a", 6, 2, "v"), ("b", 1, 1, "x"), ("b", 2, None, "x"), ("b", 3, 0, "x"), (None, 1, 0, "n")]
    got = l.guarded(spark.createDataFrame(rows, "k string, seq int, expected int, v string"), "k", ["seq"], "expected").collect()
    assert {(r["k"], r["seq"]): (r["accepted"], r["revision"]) for r in got} == {
        ("a", 1): (True, 1), ("a", 2): (False, 1), ("a", 3): (False, 1), ("a", 4): (True, 2), ("a", 5): (False, 2), ("a", 6): (True, 3), ("b", 1): (False, 0), ("b", 2): (False, 0), ("b", 3): (True, 1), (None, 1): (True, 1),
    }
    rnd = random.Random(1)
    many = [(k, s, rnd.randint(0, 6), "v") for k in range(30) for s in range(40)]
    got = {(r["k"], r["seq"]): r["revision"] for r in l.guarded(spark.createDataFrame(rnd.sample(many, len(many)), "k int, seq int, expected int, v string"), "k", ["seq"], "expected").collect()}
    for k in range(30):
        revision = 0
        for _, s, e, _ in sorted(r for r in many if r[0] == k):
            revision += e == revision
            assert got[k, s] == revision


def test_rule_trees_are_checked(spark):
    schema = spark.createDataFrame([("a", 1.0, date(2024, 1, 1), True)], "t string, n double, d date, b boolean").schema
    cases = {
        "leaf without field": {"op": "eq", "value": 1}, "leaf without op": {"field": "t"}, "field x": {"field": "x", "op": "eq"}, "operator contains on n": {"field": "n", "op": "contains", "value": "1"}, "value of n": {"field": "n", "op": "eq", "value": "1"}, "value of t": {"field": "t", "op": "eq", "value": 1},
        "value of between on n": {"field": "n", "op": "between", "value": [1]}, "value of in on t": {"field": "t", "op": "in", "value": "ab"}, "empty group": {"any": []},
    }
    assert {k: rules.checked(v, schema) for k, v in cases.items()} == {k: [k] for k in cases}
    for fine in ({"field": "d", "op": "lt", "value": "2024-02-01"}, {"field": "d", "op": "eq", "value": date(2024, 1, 1)}, {"field": "b", "op": "is_true"}, {"field": "n", "op": "in", "value": [1, 2.5]}):
        assert rules.checked(fine, schema) == []
    fields = spark.createDataFrame(rules.catalog(schema), "field string, kind string, operators array<string>")
    leaves = spark.createDataFrame([(1, "t", "text", "eq"), (2, "x", "text", "eq"), (3, "n", "text", "eq"), (4, "b", "boolean", "eq"), (5, None, None, None), (6, "t", "text", None)], "rule int, field string, kind string, op string")
    assert {(r["rule"], r["issue"]) for r in rules.mapping_issues(leaves, fields).collect()} == {(2, "absent"), (3, "kind changed"), (4, "operator not allowed"), (5, "absent"), (6, "operator not allowed")}


# ---- families and sketches


def test_families_go_on_only_where_they_may(spark):
    line = lambda d, p, text, x=90.0, y=40.0: (d, p, text, x, y, 600.0, 800.0)
    rows = [
        line(1, 1, "How do I interpret this requirement?"), line(1, 2, "plain"), line(1, 4, "plain"), line(1, 5, "plain"), line(1, 6, "Indicators: 2"), line(1, 7, "1.2.3", 30.0), line(1, 8, "1.2.3", 30.0, 760.0), line(1, 9, "Indicator"), line(1, 9, "REQUIREMENT"), line(1, 10, "x"),
        line(2, 1, "Applicability: all"), line(2, 1, "a. do", 250.0), line(2, 1, "B. see", 400.0), line(2, 2, "x"), line(3, 1, "Applicability: all"), line(3, 1, "a. do", 90.0), line(3, 1, "B. see", 400.0), line(4, 1, None), line(4, 2, "Required client actions"), line(4, 2, "the required CAB actions"),
        line(5, 1, "Indicator: a"), line(5, 2, "Requirement: b"), line(6, 1, "Indicator: a"), line(6, 1, "Requirement: b"),
    ]
    df = spark.createDataFrame(rows, "document long, page long, text string, x0 double, y0 double, width double, height double")
    got = {(r["document"], r["page"]): (r["family"], r["inherited"]) for r in families.resolved(families.evidence(df)).collect()}
    n, s = families.NORMATIVE, families.SINGLE
    assert got == {
        (1, 1): (n, False), (1, 2): (n, True), (1, 4): (None, False), (1, 5): (n, True), (1, 6): (s, False), (1, 7): (s, True), (1, 8): (None, False), (1, 9): (families.LEGACY, False), (1, 10): (None, False),
        (2, 1): (families.AUDIT, False), (2, 2): (None, False), (3, 1): (None, False), (4, 1): (None, False), (4, 2): (families.AUDIT, False), (5, 1): (None, False), (5, 2): (None, False), (6, 1): (n, False),
    }


def test_sketched_medians(spark):
    rnd = random.Random(3)
    rows = [(k, rnd.gauss(0, 1) if rnd.random() < 0.9 else None) for k in (1, 1, 1, 2) for _ in range(5000)] + [(3, None), (4, 7.0)]
    df = spark.createDataFrame(rows, "k int, x double").repartition(16)
    marks = profiles.medians(df, ["k"], {"m": "x"}, 400)
    got = {r["k"]: r["m"] for r in marks.collect()}
    assert got[3] is None and got[4] == 7.0 and abs(got[1]) < 0.1
    near = {r["k"]: r["m_near"] for r in profiles.ranked(df, marks, ["k"], {"m": "x"}, 0.0133).collect()}
    assert near[1] and near[2] and near[4]


# ---- failures


def test_failures_as_stream_and_as_log(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(rnd.randrange(6), s, *rnd.choice([("failed", "HtmlProfileError:a"), ("failed", "b"), ("failed", "upstream_x"), ("usable", None), ("other", None), ("failed", None)])) for s in range(240)]
    log = spark.createDataFrame(rows, failures.EVENT)
    want = sorted(map(tuple, failures.folded(log).collect()))
    plain = []
    for item in range(6):
        open_codes = []
        for _, s, kind, code in sorted(r for r in rows if r[0] == item):
            open_codes, made = failures.step(open_codes, kind, code)
            plain += [(item, s, e, c) for e, c in made]
    assert want == sorted(plain) and any(e == "recovered" for *_, e, _ in want) and not any(e == "recovered" and c.startswith("upstream") for *_, e, c in want)
    # the query is stopped and taken up again between the files
    for k in range(3):
        spark.createDataFrame(rows[80 * k : 80 * k + 80], failures.EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        events = spark.readStream.schema(failures.EVENT).parquet(f"{tmp_path}/in")
        failures.retained(events).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select(*failures.OUT.names).collect())) == want


# ---- newer contents


def test_candidates_by_digest(spark):
    held = spark.createDataFrame([(1, "a", "a", 3), (2, "a", "b", 3), (3, "a", "a", 3), (4, "a", "b", 3), (5, "a", "b", 3), (6, None, None, 1), (8, "a", "a", 2)], "id long, base string, current string, revision long")
    offers = spark.createDataFrame([(1, "c", 3), (2, "c", 3), (3, "c", 2), (4, "b", 1), (5, "a", 3), (6, "z", 1), (7, "n", 1), (8, "x", 2), (8, "y", 2), (8, "w", 1)], "id long, digest string, revision long")
    got = {r["id"]: (r["choice"], r["digest"]) for r in updates.reconciled(held, offers).collect()}
    assert got == {1: ("adopt", "c"), 2: ("merge", "b"), 3: ("stale", "a"), 4: ("keep", "b"), 5: ("keep", "b"), 6: ("adopt", "z"), 7: ("new", "n"), 8: ("adopt", "x")}


def test_fetches_by_digest(spark):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    stored = spark.createDataFrame([(1, sha("a"), 1), (2, sha("a"), 1), (3, sha("a"), 1), (4, None, None), (5, sha("a"), 1), (6, sha("a"), 1)], "id long, digest string, checked_at int")
    fetches = spark.createDataFrame([(1, 2, 200, "a"), (1, 1, 200, "old"), (2, 2, 200, "b"), (3, 2, 404, "gone"), (4, 2, 200, ""), (5, 2, 200, None), (7, 2, 200, "n"), (2, 3, 200, "c")], "id long, at int, status int, content string")
    got = {r["id"]: (r["outcome"], r["digest"], r["checked_at"]) for r in updates.checked(stored, fetches).collect()}
    assert got == {1: ("unchanged", sha("a"), 2), 2: ("changed", sha("c"), 3), 3: ("failed", sha("a"), 1), 4: ("first", sha(""), 2), 5: ("failed", sha("a"), 1), 6: ("unasked", sha("a"), 1), 7: ("first", sha("n"), 2)}
