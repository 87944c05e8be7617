"""Files that cannot be read, and what providers may not do: rows with an issue, never an error."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from factloom.functions import wording
from factloom.operators import delivery as d
from factloom.operators import graph as g
from factloom.operators import ledger as l
from factloom.operators import providers as p
from factloom.sources import html, xlsx


def codes(raw):
    return [(i["code"], i["at"]) for i in xlsx.scan(raw)["issues"]]


def with_sheet(xml: str, shared: str | None = None) -> bytes:
    """A workbook whose one sheet is the given XML."""
    whole, out = xlsx.workbook({"S": [["x"]]}), io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(whole)) as a, zipfile.ZipFile(out, "w") as b:
        for n in a.namelist():
            b.writestr(n, xml if n.endswith("s1.xml") else a.read(n))
        if shared:
            b.writestr("xl/sharedStrings.xml", shared)
    return out.getvalue()


def sheet(inner: str) -> str:
    return f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{inner}</worksheet>'


def test_workbooks_that_are_none():
    assert codes(None) == codes(b"") == codes(b"PK\x03\x04 cut") == [("not_a_workbook", None)]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<x/>")
    assert codes(out.getvalue()) == [("not_a_workbook", None)]
    assert codes(with_sheet("<worksheet")) == [("sheet_unreadable", "S")]


def test_cells_that_are_wrong():
    raw = with_sheet(sheet('<sheetData><row><c r="A1"><v>1</v></c><c r="A1"><v>2</v></c><c r="ZZZZ1"/><c><v>3</v></c><c r="B1" t="s"><v>0</v></c><c r="C1" t="s"><v>9</v></c></row></sheetData><mergeCells><mergeCell ref="B2:A1"/><mergeCell ref="A1:B2"/></mergeCells>'), '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>hello</t></si></sst>')
    got = xlsx.scan(raw)
    assert [(c["coordinate"], c["value"]) for c in got["cells"]] == [("A1", "1"), ("B1", "hello"), ("C1", None)]
    assert codes(raw) == [("duplicate_coordinate", "S!A1"), ("coordinate", "S!ZZZZ1"), ("coordinate", "S!None"), ("shared_string", "S!C1"), ("merge_range", "S!B2:A1")]
    assert [m["range"] for m in got["merges"]] == ["A1:B2"]
    assert xlsx.place("AB12") == (12, 28) and xlsx.place("XFE1") is None and xlsx.place("A0") is None and xlsx.rectangle("A1:B2:C3") is None


def test_audit_of_shared_formulas(spark):
    f = lambda text, si="0", ref=None: (text, {"t": "shared", "si": si} | ({"ref": ref} if ref else {}))
    good, lost, out = [[f("B1*2", ref="A1:A2")], [f("")]], [[f("", "1")]], [[f("B1", "2", "A1:A1")], [f("", "2")]]
    files = spark.createDataFrame([(n, xlsx.workbook({"S": s})) for n, s in (("good", good), ("lost", lost), ("out", out), ("none", [[f("B1", "3")]]))], "path string, content binary")
    got = {(r["path"], r["code"], r["at"]) for r in xlsx.audited(xlsx.scanned(files)).collect()}
    assert got == {("lost", "shared_formula_anchor_missing", "A1"), ("out", "shared_formula_outside_anchor_range", "A2"), ("none", "shared_formula_anchor_range_invalid", "A1")}


def test_registers(spark):
    books = {"ok": [["t"], ["source_id", " n "], ["a", "1"], ["", "2"], [None, "3"]], "twice": [["t"], ["source_id", "source_id"]], "short": [["t"], ["n"]], "empty": [["t"]]}
    files = spark.createDataFrame([(n, xlsx.workbook({"S": s})) for n, s in books.items()] + [("bad", b"x")], "path string, content binary")
    got = {(r["path"], r["row"], str(r["record"]), r["issue"]) for r in xlsx.registry_rows(xlsx.scanned(files), ["source_id"]).collect()}
    assert got == {("ok", 3, str({"n": "1", "source_id": "a"}), None), ("twice", None, "None", "duplicate_header"), ("short", None, "None", "missing_column"), ("empty", None, "None", "no_header"), ("bad", None, "None", "not_a_workbook")}


def test_pages(spark, monkeypatch):
    page = '<body><div class="chapter"><h2>One</h2><p class="paragraph">a <a data-id="law-1">b</a></p></div><p>loose</p><ul><li>x<ul><li>y</li></ul></li></ul><script>z</script></body>'
    found = html.nodes(spark.createDataFrame([(1, page), (2, None), (3, "<p>")], "page_id long, html string"))
    assert [tuple(r) for r in html.chapters(found).where("page_id = 1").collect()] == [(1, 1, 1, 1)]
    assert {(r["kind"], r["name"], r["value"]) for r in html.references(found).collect()} == {("reference", "law", "law-1"), ("item", "1", "x"), ("item", "2", "y")}
    assert {(r["page_id"], r["profile"], r["issue"]) for r in html.profile(found).collect()} == {(1, "chapters", None), (3, None, "none")}
    assert html.span("2000") is None and html.span("3") == 3 and html.grid([(0, "a", None, 1)], 1)[1] == ["span:a"]
    monkeypatch.setattr(html, "MAX_NODES", 3)
    assert [n["tag"] for n in html.shred("<p>a<p>b<p>c<p>d<br/><i>e</i>")] == ["p", "p", "p", "#cut"]


def test_formats(spark):
    rows = [("a.pdf", None, b"%PDF-1"), ("a.bin", None, b"<HTML>"), ("a.html", "pdf", b"<html>"), ("x", None, b""), ("a.txt", None, None)]
    df = spark.createDataFrame(rows, "name string, declared string, content binary")
    assert [r[0] for r in df.select(d.format_of(F.col("name"), F.col("declared"), F.col("content"))).collect()] == ["pdf", "html", "mismatch:pdf", "unsupported:", "unsupported:txt"]


def test_providers_cost_no_other_record(spark):
    def odd(record):
        if record["n"] == 2:
            raise RuntimeError("down")
        return {1: [{"source_id": "a", "reason": "r", "proposed_updates": {"issuer": "x"}}], 3: "text", 4: [5], 5: [{"source_id": "e", "reason": "r", "proposed_updates": {"hash": 1}}]}[record["n"]]

    df = spark.createDataFrame([(i, x) for i, x in enumerate("abcde", 1)], "n int, source_id string")
    found = p.suggestions(df, {"odd": odd, "idle": lambda record: []})
    assert [r["error"] for r in found.orderBy("source_id").collect()] == [None, "RuntimeError: down", "ValueError: not a list", "ValueError: not an object", "ValueError: non-governed fields"]
    assert [tuple(r) for r in p.status(found).collect()] == [("odd", "DEGRADED", 1, 4)]


def test_ledger_and_captures(spark):
    asked = spark.createDataFrame([("k", 1, 0.5, 1), ("k", 2, 0.7, 1), ("k", 3, 2.0, 2), ("k", 4, None, 2), ("k", 5, 0.9, 2)], "k string, seq int, value double, expected int")
    assert [(r["accepted"], r["revision"]) for r in l.appended(asked, "k", "seq").orderBy("seq").collect()] == [(True, 2), (False, 2), (False, 2), (False, 2), (True, 3)]
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "id string, value string")
    other = spark.createDataFrame([("b", "3"), ("c", None), ("d", "4")], "id string, value string")
    steps = g.preview(now, other, ["id"])
    half = g.applied(now, steps.where("id = 'a'"), ["id"])
    whole = g.applied(g.applied(half, g.preview(half, other, ["id"]), ["id"]), steps, ["id"])
    assert sorted(whole.collect()) == sorted(other.collect()) and g.preview(whole, other, ["id"]).isEmpty()
    assert tuple(l.compared(now, other).first()) == (3, 4)


def test_cycles_and_long_paths(spark):
    chain = [(i, i + 1) for i in range(150)]
    df = spark.createDataFrame([*chain, (200, 201), (201, 202), (202, 200), (202, 203), (204, 200), (203, 205), (205, 206), (206, 205)], "src long, dst long")
    assert sorted(r["id"] for r in g.cyclic(df).collect()) == [200, 201, 202, 205, 206]
    far = g.closure(spark.createDataFrame(chain, "src long, dst long"))
    assert far.where("node = 0 and reached = 150").first()["depth"] == 150 and far.count() == 150 * 151 // 2


@pytest.mark.parametrize(("text", "kinds"), [("over any 12-month period, every 2 weeks and yearly", ["rolling", "every", "annual"]), ("in the first three years", ["first"]), ("at once", [])])
def test_windows(text, kinds):
    got = wording.windows(text)
    assert [w["kind"] for w in got] == kinds and all(text[w["start"] : w["end"]] == w["text"] for w in got)


def test_statements_and_scopes():
    text = "Operators shall be trained if new, except for staff, by 2024-05-01. They may not smoke (see annex B)."
    one, two = wording.statements(text)
    assert (one["entity"], one["modality"], one["action"], one["date"], one["condition"]) == ("Operators", "shall", "trained", "2024-05-01", "new, except for staff, by 2024-05-01")
    assert (two["entity"], two["modality"], two["action"], two["refs"]) == ("They", "may not", "smoke", ["annex B"]) and one["digest"] != two["digest"]
    assert [s["text"] for s in wording.scopes("Fish farms are exempt from the rules. So there.")] == ["are exempt from the rules"]
    assert wording.scopes("It asks which rules apply to farms") == [] == wording.scopes('"Rules apply to farms"') and len(wording.scopes("Rationale which is long.\nRules apply to farms.")) == 1
