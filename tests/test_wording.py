"""Literal cases of the readings of text: what each rule takes and what it leaves."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factloom.functions import wording


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("It must be done, and the crew MAY NOT leave.", ["must", "MAY NOT"]), ("Mai skal komme; det kan ikke vente.", ["skal", "kan ikke"]), ("Mustard may be fine.", []), ("required or prohibited", ["required", "prohibited"]), ("", []),
    ],
)
def test_normative(text, want):
    got = wording.normative(text)
    assert [s["text"] for s in got] == want and all(text[s["start"] : s["end"]] == s["text"] for s in got)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("These rules are not applicable to sheds.", ["rules are not applicable to"]), ("The standard applies when wet. Criteria do not apply within 5 km.", ["standard applies when", "Criteria do not apply within"]),
        ("Boats are not exempt from the provisions.", ["are not exempt from the provisions"]), ("The rules apply.", []), ("They said rules apply to boats.", []), ("Do rules apply to boats?", []), ("See which rules apply to boats. Rules apply to nets.", ["Rules apply to"]),
        ("A draft. Rules apply to nets.", []), ("1.5 m nets: rules apply for all", ["rules apply for"]),
    ],
)
def test_scopes(text, want):
    assert [s["text"] for s in wording.scopes(text)] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("for the first 3 years of use", [("first", "first 3 years")]), ("within the previous twelve months period", [("rolling", "within the previous twelve months period")]), ("over 12 - month", [("rolling", "over 12 - month")]),
        ("each of the previous 3 production cycles", [("cycle", "each of the previous 3 production cycles")]), ("during the most recent complete production cycle", [("cycle", "during the most recent complete production cycle")]),
        ("per 2 weeks, monthly, per year", [("every", "per 2 weeks"), ("every", "monthly"), ("annual", "per year")]), ("annual targets", [("annual", "annual targets")]), ("within 5 days", []), ("any day", []),
    ],
)
def test_windows(text, want):
    assert [(w["kind"], w["text"]) for w in wording.windows(text)] == want


def test_statement_parts():
    text = "In all: the operator shall re-check >= 3.5 °C tanks unless idle. Crew is prohibited from smoking, see Fig. 2-b and table A1."
    one, two = wording.statements(text)
    assert (one["entity"], one["modality"], one["action"], one["object"]) == ("In all: the operator", "shall", "re-check", ">= 3.5 °C tanks unless idle. Crew is prohibited from smoking, see Fig. 2-b and table A1.")
    assert (one["threshold"], one["exception"], one["condition"], one["date"]) == (">= 3.5 °C", "idle", None, None)
    assert (two["entity"], two["modality"], two["action"], two["refs"]) == ("Crew is", "prohibited from", "smoking", ["Fig. 2-b", "table A1."])
    (bare,) = wording.statements("must")
    assert (bare["entity"], bare["action"], bare["object"]) == (None, None, None)
    assert wording.statements("On 3 May 2024 it should be read.")[-1]["date"] == "3 May 2024" and wording.statements("") == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("For any queries about nets, please contact a.b@c.no.", "support_contact"), ("For questions on nets. Please contact a@c.no", None), ("For questions on nets, please contact a@c.no or me", None),
        ("3 Smith, J. A. 2019a. On nets. Feed & Net 12(3), 4–9. https://x.y/z", "bibliographic_reference"), ("Smith, J. 2019. On nets. https://x.y", None), ("Smith 2019", None), ("", None),
    ],
)
def test_genres(text, want, spark):
    assert spark.createDataFrame([(text,)], "t string").select(wording.genre(F.col("t"))).first()[0] == want


def test_cascade(spark):
    rows = {
        ("source_table_assembly", "", "It must."): ("context", 1), ("coverage", "", "It must."): ("context", 2), ("p", "", "Rationale: x\n1.2.3 do"): ("undetermined", 3), ("p", "Rationale", "Indicator: a"): ("undetermined", 3),
        ("p", "", "Rationale\nIt must."): ("context", 4), ("p", "How do I interpret this requirement?", "It must."): ("context", 4), ("p", "", "Rationale is a word here"): ("undetermined", 12), ("p", "", "Indicator: a\nRequirement: b"): ("requirement", 5),
        ("p", "", "Indicator: a\nRequirement: "): ("undetermined", 12), ("p", "", "It must."): ("requirement", 6), ("p", "", "Rules apply to nets."): ("requirement", 7), ("standard_principle", "", "Nets"): ("requirement", 8), ("p", "", "'must' means a duty."): ("context", 9),
        ("p", "T", "'must' means a duty."): ("undetermined", 12), ("source_heading", "Nets", ""): ("context", 10), ("p", "", "For questions on nets, please contact a@c.no"): ("context", 11), ("p", None, None): ("undetermined", 12),
    }
    df = spark.createDataFrame(list(rows), "kind string, title string, body string")
    named, rule, _, _ = wording.classification(F.col("kind"), F.col("title"), F.col("body"))
    assert [(r[0], r[1]) for r in df.select(named, rule).collect()] == list(rows.values())
    above = wording.classification(F.lit("p"), F.lit(""), F.lit("It must."), F.lit(" rationale "))
    assert spark.range(1).select(above[0], above[1]).first()[:] == ("context", 4)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("x = 1\nfrom a import b", "python"), ("class A:", "python"), ('{"a": 1}', "json"), ("#!/bin/bash", "shell"), ("sudo curl x", "shell"), ("please CREATE TABLE t", "sql"), ("selected", None), ("a => b", "javascript"), ("console.log(1)", "javascript"), ("Const x", None), ("", None),
    ],
)
def test_languages(text, want, spark):
    assert spark.createDataFrame([(text,)], "t string").select(wording.code_language(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(
    ("tex", "want"),
    [
        (r"\operatorname*{l i m}_x", r"\lim_x"), (r"\operatorname{f o o}", r"\operatorname{f o o}"), (r"x_{_{ab}}", r"x_{ab}"), (r"x_{_{a}b}", r"x_{_{a}b}"), (r"\inf_{n}", r"\mathop{\inf}\limits_{n}"), (r"\infty_n", r"\infty_n"),
        (r"[1, \ldots] \[ \]", r"\left\lbrack 1, \ldots \right\rbrack \[ \]"), ("[1, 2]", "[1, 2]"), (r"{ \begin{split} a \\ b \end{split} }", r"\begin{split} a \\ b \end{split}"), ("{a}", "{a}"),
        (r"\begin{bmatrix}1&\vdots&2\\3&\vdots&4\end{bmatrix}", r"\begin{bmatrix}1&2\\3&4\end{bmatrix}"), (r"\begin{bmatrix}1&\vdots&2\\3&4\end{bmatrix}", r"\begin{bmatrix}1&\vdots&2\\3&4\end{bmatrix}"),
        (r"\left(x\right)_{0}^{1}", r"\Bigg[x\Bigg]_{0}^{1}"), (r"\left(x\right)_{0}", r"\left(x\right)_{0}"), ("", ""),
    ],
)
def test_formulas(tex, want, spark):
    assert spark.createDataFrame([(tex,)], "t string").select(wording.plain_formula(F.col("t"))).first()[0] == want
