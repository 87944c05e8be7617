"""Sentences of many shapes in both languages, with what is to be read from each, worked by hand."""

from __future__ import annotations

import pytest

from factloom.functions import semantics, wording

#: sentence; modalities; negations; (kind, text) of conditions and exceptions; (operator, value, end, unit) of thresholds
SHAPES = [
    ("The crew shall log each catch.", ["obligation"], 0, [], []),
    ("The crew shall not log it.", ["prohibition"], 1, [], []),
    ("Boats may fish here.", ["permission"], 0, [], []),
    ("Boats may not fish here.", ["prohibition"], 1, [], []),
    ("Staff should not smoke.", ["recommendation"], 1, [], []),
    ("Operators need to report.", ["obligation"], 0, [], []),
    ("It opens on 3 May 2024.", [], 0, [], []),
    ("In May 2024 they may leave.", ["permission"], 0, [], []),
    ("Båten skal melde fra.", ["obligation"], 0, [], []),
    ("Båten skal ikke gå ut.", ["prohibition"], 1, [], []),
    ("Fisket kan starte.", ["permission"], 0, [], []),
    ("Fisket kan ikke starte.", ["prohibition"], 1, [], []),
    ("Nets must dry if wet.", ["obligation"], 0, [("condition", "if wet")], []),
    ("When it rains, doors must shut.", ["obligation"], 0, [("condition", "When it rains")], []),
    ("Doors must shut unless staff is in, at night.", ["obligation"], 0, [("exception", "unless staff is in")], []),
    ("Provided that it is dry, go.", [], 0, [("condition", "Provided that it is dry")], []),
    ("Only if asked; except on Monday.", [], 0, [("condition", "Only if asked"), ("exception", "except on Monday")], []),
    ("Dersom det regner, må døren lukkes.", ["obligation"], 0, [("condition", "Dersom det regner")], []),
    ("Alle må møte, med mindre de er syke.", ["obligation"], 0, [("exception", "med mindre de er syke")], []),
    ("Hold at least 5 kg.", [], 0, [], [("gte", 5.0, None, "kg")]),
    ("Hold no more than ten days.", [], 1, [], [("lte", 10.0, None, "days")]),
    ("A minimum of twelve hours.", [], 0, [], [("gte", 12.0, None, "hours")]),
    ("Less than 3,5 mg/l is fine.", [], 0, [], [("lt", 3.5, None, "mg/l")]),
    ("Exactly 1,000 g", [], 0, [], [("eq", None, None, "g")]),
    ("Between 5 and 10 kg.", [], 0, [], [("range", 5.0, 10.0, "kg")]),
    ("from two to four weeks", [], 0, [], [("range", 2.0, 4.0, "weeks")]),
    ("3-5 days", [], 0, [], [("range", 3.0, 5.0, "days")]),
    (">= 4 °C", [], 0, [], [("gte", 4.0, None, "°c")]),
    ("=< 7 %", [], 0, [], [("lte", 7.0, None, "%")]),
    ("A 20 km zone", [], 0, [], [("eq", 20.0, None, "km")]),
    ("at least one of the following", [], 0, [], []),
    ("minst fem dager", [], 0, [], [("gte", 5.0, None, "dager")]),
    ("ikke mer enn to timer", [], 1, [], [("lte", 2.0, None, "timer")]),
    ("mindre enn 12 prosent", [], 0, [], [("lt", 12.0, None, "prosent")]),
    ("mer enn tolv tonn", [], 0, [], [("gt", 12.0, None, "tonn")]),
    ("innen 3 måneder", [], 0, [], [("lte", 3.0, None, "måneder")]),
    ("mellom to og fire uker", [], 0, [], [("range", 2.0, 4.0, "uker")]),
    ("nøyaktig åtte kg", [], 0, [], [("eq", 8.0, None, "kg")]),
    ("It is at least to some a fire.", [], 0, [], []),
    ("høyst 1.5 m", [], 0, [], [("lte", 1.5, None, "m")]),
    ("equal to 6 litres", [], 0, [], [("eq", 6.0, None, "litres")]),
    ("No boats.", [], 1, [], []),
]


@pytest.mark.parametrize(("text", "kinds", "negations", "contexts", "thresholds"), SHAPES, ids=[s[0] for s in SHAPES])
def test_shapes(text, kinds, negations, contexts, thresholds):
    assert [m["kind"] for m in semantics.modalities(text)] == kinds
    assert len(semantics.negations(text)) == negations
    got = semantics.contexts(text)
    assert [(c["kind"], c["text"]) for c in got] == contexts and all(text[c["start"] : c["end"]] == c["text"] for c in got)
    assert [(t["operator"], t["value"], t["end_value"], t["unit"]) for t in semantics.thresholds(text)] == thresholds


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Small farms are exempt from this, but report.", [(False, "are exempt from this")]), ("Ships are not exempted.", [(True, "are not exempted")]), ("An exemption may apply to nets; ask.", [(False, "An exemption may apply to nets")]),
        ("The exemptions are available.", [(False, "The exemptions are available")]), ("An exemption was asked for.", []), ("", []),
    ],
)
def test_exemptions(text, want):
    got = semantics.exemptions(text)
    assert [(e["denied"], e["text"]) for e in got] == want and all(text[e["start"] : e["end"]] == e["text"] for e in got)


def test_one_reading_has_all():
    got = wording.bundle("Farms must test every 2 weeks, see section 4.1 and annex B, unless an exemption applies.")
    assert [w["text"] for w in got["windows"]] == ["every 2 weeks"] and got["references"] == ["section 4.1", "annex B"] and [e["text"] for e in got["exemptions"]] == ["an exemption applies"]
    assert [c["kind"] for c in got["contexts"]] == ["exception"] and got["modalities"][0]["kind"] == "obligation" and got["language"]["language"] == "en"
