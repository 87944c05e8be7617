"""Ropes against plain strings, and what comes back from every form."""

from __future__ import annotations

import random
import re

from factloom.llm import infill


def test_ropes_split_and_join_like_strings():
    rnd = random.Random(1)
    for _ in range(1500):
        text = "".join(rnd.choice("ab\n<é🙂P>S") for _ in range(rnd.randint(0, 60)))
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        whole = infill.rope(text, 4)
        assert whole.units() == len(units) and str(whole) == text
        a, b = sorted((rnd.randint(0, len(units)), rnd.randint(0, len(units))))
        head, suffix = infill.split(whole, b)
        prefix, middle = infill.split(head, a)
        assert (str(prefix), str(middle), str(suffix)) == ("".join(units[:a]), "".join(units[a:b]), "".join(units[b:]))
        assert str(infill.split(whole, a, "chars")[0]) == text[:a]
        if text and not any(m in text for m in ("<P>", "<S>", "<M>")):
            for form in ("psm", "spm"):
                out, p, m = infill.rearranged(text, a, b, form == "spm")
                assert infill.restored(str(out), form) == text and (p, m) == (prefix.chars, middle.chars)


def test_ropes_stay_level():
    out = infill.EMPTY
    for i in range(3000):
        out = infill.concat(out, infill.leaf(f"{i}\n"))
    assert out.depth <= 18 and out.lines == 3000 and str(out) == "".join(f"{i}\n" for i in range(3000))
    assert str(infill.split(out, 1234)[1]).startswith("1234\n")


def test_forms_of_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "a<S>b\nc"), (4, "one line"), (5, "\n\n"), (None, "x\ny\n"), (None, "x\ny\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("restored", infill.F.lit("clash"))
    got = infill.restore(infill.infilled(docs), "fim.output", "fim.form", to="back").collect()
    assert [(r["doc_id"], r["back"]) for r in got] == [(i, t or "") for i, t in rows] and all(r["restored"] == "clash" for r in got)
    forms = [r["fim"]["form"] for r in got]
    assert forms[:3] == ["plain"] * 3 and all(f in ("psm", "spm") for f in forms[3:]) and [r["fim"]["n"] for r in got] == [0, 0, 2, 1, 2, 2, 2]
    assert got[5]["fim"] == got[6]["fim"] and got[0]["fim"]["prefix_chars"] is None
    never = infill.infilled(docs, rate=0).select("fim.form").distinct().collect()
    assert [r[0] for r in never] == ["plain"]
