"""Repairs and exchanges against plain versions: differences, boundaries, links, orders, ledgers, grids, hierarchies."""

from __future__ import annotations

import itertools
import random
from fractions import Fraction

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.operators import boundaries as b
from factloom.operators import diff, hierarchy, mentions, ordering, sync, tablegrid


def _lcs(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def test_scripts_are_shortest_and_replay():
    rnd = random.Random(1)
    for _ in range(2000):
        a, c = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 12))] for _ in range(2))
        pairs = diff.matches(a, c)
        assert len(pairs) == _lcs(a, c) and all(a[i] == c[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(pairs))
        old, new = " ".join(a), "\n".join(c)
        runs = diff.script(old, new)
        assert diff.replay(old, new, runs) == new and "".join(old[r[1] : r[2]] for r in runs if r[0] != "insert") == old and all(p[0] != q[0] for p, q in itertools.pairwise(runs))
    assert diff.script("", "") == [] and diff.script("a", "a") == [("keep", 0, 1, 0, 1)] and diff.script("é🙂", "🙂") == [("delete", 0, 1, 0, 0), ("keep", 1, 2, 0, 1)]


def test_moved_are_the_fewest():
    rnd = random.Random(2)
    for _ in range(300):
        order = rnd.sample(range(20), rnd.randint(0, 8))
        kept = [x for x, k in zip(order, diff.stays(order), strict=True) if k]
        most = max((len(s) for n in range(len(order) + 1) for s in itertools.combinations(order, n) if list(s) == sorted(s)), default=0)
        assert kept == sorted(kept) and len(kept) == most


def test_passages(spark):
    saved = spark.createDataFrame([(1, "a", 1, "x"), (1, "b", 2, "y"), (1, "c", 3, None), (1, "d", 4, "z"), (2, "a", 1, "x")], "doc long, id string, at int, text string")
    local = spark.createDataFrame([(1, "d", 1, "z"), (1, "a", 2, "x"), (1, "b", 3, "Y"), (1, "c", 4, None), (1, "e", 5, "n")], "doc long, id string, at int, text string")
    got = {(r["doc"], r["id"]): (r["change"], r["moved"]) for r in diff.passages(saved, local, "doc", "id", "at", "text").collect()}
    assert got == {(1, "a"): ("same", False), (1, "b"): ("changed", False), (1, "c"): ("same", False), (1, "d"): ("same", True), (1, "e"): ("added", False), (2, "a"): ("removed", False)}


UNIT = "document long, id long, ordinal long, parent long, kind string, text string"


def test_merge_refusals(spark):
    rows = [(1, 1, 1, None, "p", "a"), (1, 2, 2, None, "p", "b"), (1, 3, 3, 9, "p", "c"), (1, 4, 4, None, "table", "d"), (1, 5, 5, None, "coverage", "e"), (1, 6, 6, None, "p", " "), (1, 7, 7, 8, "p", "g"), (1, 8, 8, 8, "p", "h"), (1, 9, 9, None, "p", "i"), (1, 10, 10, None, "p", "j"), (2, 11, 1, None, "p", None)]
    units = b.original(spark.createDataFrame(rows, UNIT))
    asked = [(1, 1), (1, 2), (2, 3), (2, 9), (3, 4), (3, 3), (4, 5), (4, 6), (5, 6), (5, 9), (6, 1), (6, 99), (7, 7), (7, 8), (8, 10), (9, 1), (9, 9)]
    requests = spark.createDataFrame([(1, r, i) for r, i in asked], "document long, request int, id long")
    reasons = {r["request"]: r["reason"] for r in b.merged(units, requests.where("request not in (6, 9, 2, 3, 5)"))[1].collect()}
    assert reasons == {1: None, 4: "coverage check", 7: "different parents", 8: "needs two units or more, none twice"}
    reasons = {r["request"]: r["reason"] for r in b.merged(units, requests.where("request in (2, 3, 5, 6)"))[1].collect()}
    assert reasons == {2: "unit in two requests", 3: "unit in two requests", 5: "unit in two requests", 6: "unknown unit"}
    alone = lambda r: b.merged(units, requests.where(F.col("request") == r))[1].first()["reason"]
    assert [alone(r) for r in (2, 3, 5, 9)] == ["different parents", "table boundary", "no text", "not adjacent"]
    out = {r["id"]: r["text"] for r in b.merged(units, requests.where("request = 1"))[0].collect()}
    assert out[1] == "a\nb" and 2 not in out and len(out) == 10 and out[11] == ""


def test_no_character_is_lost(spark):
    """Merges, splits and merges of the parts: every code point of the first texts is in one place, and the maps rebuild the texts."""
    rnd = random.Random(3)
    rows = [(d, 100 * d + k, k, None, "p", "".join(rnd.choice("aé🙂 b\n") for _ in range(rnd.randint(1, 12))) + "x") for d in range(30) for k in range(1, 7)]
    texts = {r[1]: r[5] for r in rows}
    units = b.original(spark.createDataFrame(rows, UNIT))
    merges = [(d, 1, 100 * d + k) for d in range(30) for k in range(2, 2 + rnd.randint(2, 4))]
    whole, verdicts = b.merged(units, spark.createDataFrame(merges, "document long, request int, id long"))
    assert verdicts.where("reason is not null").isEmpty()
    cuts = [(d, 100 * d + k, sorted(rnd.sample(range(0, 20), 2))) for d in range(30) for k in (1, 2)] + [(3, 999, [1]), (4, 405, []), (5, 506, [1]), (5, 506, [2])]
    parts, told = b.divided(whole, spark.createDataFrame(cuts, "document long, id long, cuts array<int>"))
    reasons = {(r["document"], r["id"]): r["reason"] for r in told.collect()}
    assert reasons[3, 999] == "unknown unit" and reasons[5, 506] == "asked twice" and reasons[4, 405] in ("no cuts", "unknown unit") and None in reasons.values() and "cuts outside or not rising" in reasons.values()
    got = parts.collect()
    held = {}
    for r in got:
        at = 0
        for p in r["pieces"]:
            assert p["at"] == at
            piece = r["text"][at : at + p["end"] - p["start"]]
            at += p["end"] - p["start"]
            if p["source"] is None:
                assert piece == "\n"
                continue
            assert piece == texts[p["source"]][p["start"] : p["end"]]
            for k in range(p["start"], p["end"]):
                assert held.setdefault((p["source"], k), r["id"]) == r["id"] and (p["source"], k) in held
        assert at == len(r["text"])
    assert sum(p["end"] - p["start"] for r in got for p in r["pieces"] if p["source"] is not None) == len(held) == sum(map(len, texts.values()))
    again = b.rebuilt(parts, spark.createDataFrame(list(texts.items()), "source long, original string"))
    assert {(r["id"], r["part"]): r["text"] for r in again.collect()} == {(r["id"], r["part"]): r["text"] for r in got}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("See Table 3 and Figs 2.", [("table", "3", "label")]), ("tables 1, 2 and A-4.1; Fig.7", [("table", "1", "label"), ("table", "2", "label"), ("table", "a-4.1", "label"), ("figure", "7", "label")]),
        ("Section 4.2. Annex B, clause IV", [("section", "4.2", "label"), ("section", "b", "label"), ("section", "iv", "label")]), ("the table of contents, a section on civil law", []),
        ("the table below and the following figure", [("table", None, "below"), ("figure", None, "below")]), ("in figure above", [("figure", None, "above")]), ("noted [^3] and [12] but [123] [x]", [("footnote", "3", "note"), ("footnote", "12", "note")]), ("", []),
    ],
)
def test_mentions(text, want):
    got = mentions.mentions(text)
    assert [(m["kind"], m["label"], m["way"]) for m in got] == want and all(text[m["start"] : m["end"]] == m["text"] for m in got)


def test_links_take_the_nearest_scope(spark):
    rows = [
        (1, 1, 0, "table", "Table 1 a"), (1, 2, 0, "paragraph", "Table 1, Table 2 and Table 9"), (1, 3, 1, "table", "Table 2 b"), (1, 4, 2, "table", "Table 1 c"), (1, 5, 2, "paragraph", "Table 1; Table 2"), (1, 6, 1, "paragraph", "Table 1 (see Section 3)"),
        (1, 7, 2, "heading", "Section 3 Rules, as in Section 3"), (2, 8, 2, "table", "Table 9 far"), (1, 9, 2, "paragraph", "the table above, the figure below"), (1, 10, 2, "footnote", "4 Said so"), (1, 11, 0, "paragraph", "so [4]."),
    ]
    blocks = spark.createDataFrame([(d, i, i, s, k, x) for d, i, s, k, x in rows], "document long, id long, ordinal long, scope long, kind string, text string")
    got = {(r["id"], r["text"]): (r["target"], r["reason"]) for r in mentions.links(blocks).collect()}
    none = "no part bears this label"
    assert got == {
        (2, "Table 1"): (1, None), (2, "Table 2"): (3, None), (2, "Table 9"): (None, none), (5, "Table 1"): (4, None), (5, "Table 2"): (3, None), (6, "Table 1"): (1, None), (6, "Section 3"): (7, None), (7, "Section 3"): (None, "itself"),
        (9, "table above"): (4, None), (9, "figure below"): (None, "no such part in scope"), (11, "[4]"): (10, None),
    }


def test_keys_outlast_doubles():
    low, high, keys = "M", "RM", []
    for i in range(400):
        k = ordering.between(low, high)
        assert low < k < high
        keys.append(k)
        low, high = (k, high) if i % 2 else (low, k)
    fractions = sorted(Fraction(*ordering.fraction(k)) for k in keys)
    assert [Fraction(*ordering.fraction(k)) for k in sorted(keys)] == fractions and len(set(fractions)) == 400
    # neighbours in this order are the same double
    assert len(set(map(float, fractions))) < 100


def test_moves_replay(spark):
    rnd = random.Random(4)
    docs = {d: list(range(1, rnd.randint(2, 9))) for d in range(20)}
    moves = [(d, s, rnd.choice([*units, 99]), rnd.choice([None, 77, *units])) for d, units in docs.items() for s in range(60)] + [(50, 1, 1, None)]
    n = F.count("*").over(Window.partitionBy("document"))
    units = spark.createDataFrame([(d, u) for d, us in docs.items() for u in us], "document long, unit long").withColumn("key", ordering.first_keys(F.col("unit"), n))
    got = ordering.moved(units, spark.createDataFrame(moves, "document long, seq int, unit long, after long")).collect()
    refused = dict.fromkeys(docs, 0)
    for d, _, u, after in moves[:-1]:
        order = docs[d]
        if u not in order or u == after or (after is not None and after not in order):
            refused[d] += 1
            continue
        order.remove(u)
        order.insert(0 if after is None else order.index(after) + 1, u)
    for d, order in docs.items():
        mine = [r for r in got if r["document"] == d]
        assert [r["unit"] for r in sorted((r for r in mine if r["key"]), key=lambda r: r["key"])] == order and sum(r["refused"] for r in mine) == refused[d]
    assert [(r["unit"], r["key"], r["refused"]) for r in got if r["document"] == 50] == [(1, None, 1)]


def test_ledgers_unite_in_any_order(spark):
    """Random histories of three peers: state by vectors against reachability over what each edit had seen."""
    rnd = random.Random(5)
    known, edits = {p: set() for p in "abc"}, {}
    for _ in range(60):
        p = rnd.choice("abc")
        if rnd.random() < 0.3:
            known[p] |= known[rnd.choice("abc")]
        item = rnd.choice("xyz")
        seen = {q: max((c for i, r, c in known[p] if (i, r) == (item, q)), default=0) for q in "abc"}
        me = (item, p, seen[p] + 1)
        edits[me] = (rnd.choice([1.0, 2.0]), seen, {e for e in known[p] if e[0] == item})
        known[p].add(me)
    rows = [(*k, v, s) for k, (v, s, _) in edits.items()]
    schema = "item string, peer string, counter long, value double, seen map<string, long>"
    cuts = [spark.createDataFrame(rnd.sample(rows, 40), schema), spark.createDataFrame(rows[::2], schema), spark.createDataFrame(rows[1:], schema), spark.createDataFrame(rows[:1], schema)]
    states = [sorted(map(tuple, sync.state(sync.united(*order)).collect())) for order in (cuts, cuts[::-1], [*cuts, *cuts[:2]])]
    assert states[0] == states[1] == states[2]
    tops = {i: sorted((p, c) for (j, p, c) in edits if j == i and not any((i, p, c) in past for _, _, past in edits.values())) for i in "xyz"}
    for item, revision, value, heads, review, _ in states[0]:
        values = {edits[item, p, c][0] for p, c in tops[item]}
        assert heads == len(tops[item]) and revision == sum(e[0] == item for e in edits) and value == (values.pop() if len(values) == 1 else None) and (review is None) == (value is not None)
    less = spark.createDataFrame([r for r in rows if r[2] != 1], schema)
    assert set(r["review"] for r in sync.state(sync.united(less)).collect()) == {"missing edits"}
    forged = spark.createDataFrame([(rows[0][0], rows[0][1], rows[0][2], 9.0, rows[0][4])], schema)
    assert sync.united(cuts[3], forged).first()["tampered"] and sync.receive(cuts[1], cuts[2]).count() == len(rows[1::2])


def test_grid_cases(spark):
    c = "table long, cell long, row int, column int, row_span int, column_span int, x0 double, y0 double, x1 double, y1 double, bound long"
    rows = [
        (1, 1, 0, 0, 1, 1, 0.0, 0.0, 9.0, 9.0, 5), (1, 2, 0, 1, 2, 1, 8.9, 0.0, 20.0, 9.0, 5), (1, 3, 1, 0, 1, 1, 0.0, 10.0, 9.0, 19.0, 5),  # a whole grid; source row 5 bound twice
        (2, 1, 0, 0, 2, 2, 0.0, 0.0, 9.0, 9.0, None), (2, 2, 1, 1, 1, 1, 0.0, 0.0, 9.0, 9.0, 1), (2, 3, 1, 2, 3, 1, 0.0, 0.0, 9.0, 9.0, 2), (2, 4, 0, 2, 0, 1, 0.0, 0.0, 9.0, 9.0, 3), (2, 5, None, 2, 1, 1, 0.0, 0.0, 9.0, 9.0, 3),
        (3, 1, 1, 1, 1, 1, 9.0, 0.0, 0.0, 9.0, None), (4, 1, 0, 0, 1, 1, 0.0, 0.0, 50.0, 9.0, None), (4, 2, 0, 1, 1, 1, 10.0, 0.0, 60.0, 9.0, None),
    ]
    tables = spark.createDataFrame([(1, 2, 2), (2, 2, 3), (3, 3, 3), (4, 1, 2), (5, 1, 2)], "table long, rows int, columns int")
    got = {tuple(r) for r in tablegrid.findings(spark.createDataFrame(rows, c), tables).collect()}
    n = None
    assert got == {
        (1, "binding", 1, 5, 0, 1, n, n), (2, "overlap", 1, 2, 1, 2, 1, 2), (2, "boundary", 2, 1, 1, 2, n, n), (2, "outside", 3, n, n, n, n, n), (2, "span", 4, n, n, n, n, n), (2, "span", 5, n, n, n, n, n), (2, "gap", n, n, 0, 1, 2, 3), (2, "gap", n, n, 1, 2, 2, 3), (2, "unbound", 1, n, n, n, n, n),
        (3, "gap", n, n, 0, 1, 0, 3), (3, "gap", n, n, 2, 3, 0, 3), (3, "gap", n, n, 1, 2, 0, 1), (3, "gap", n, n, 1, 2, 2, 3), (3, "box", 1, n, n, n, n, n), (4, "boundary", 2, 1, 0, 1, n, n), (5, "gap", n, n, 0, 1, 0, 2),
    }


def test_trees_with_cycles(spark):
    deep = [(i, i - 1 if i else None) for i in range(3000)]
    odd = [(5000, 5001), (5001, 5002), (5002, 5000), (5003, 5002), (5004, 5003), (6000, 6000), (7000, 9999), (7001, 7000), (8000, None)]
    got = {r["id"]: (r["depth"], r["root"], r["state"]) for r in hierarchy.placed(spark.createDataFrame(deep + odd, "id long, parent long")).collect()}
    assert all(got[i] == (i, 0, "fine") for i in range(3000)) and {got[i] for i in (5000, 5001, 5002, 6000)} == {(None, None, "cycle")} and {got[i] for i in (5003, 5004)} == {(None, None, "below_cycle")}
    assert got[7001] == (2, 9999, "unknown_parent") and got[8000] == (0, 8000, "fine") and len(got) == 3009
    tree = spark.createDataFrame([(i, i // 2) for i in range(1, 40)] + odd, "id long, parent long")
    up = {(r["id"], r["distance"]): r["ancestor"] for r in hierarchy.ancestors(tree, spark.createDataFrame([(37,), (5004,), (6000,)], "id long")).collect()}
    assert up == {(37, 1): 18, (37, 2): 9, (37, 3): 4, (37, 4): 2, (37, 5): 1, (37, 6): 0, (5004, 1): 5003, (5004, 2): 5002, (5004, 3): 5000, (5004, 4): 5001}
    edits = spark.createDataFrame([(1, 7, 1), (1, None, 2), (2, 3, 1), (99, 1, 1)], "id long, parent long, at int")
    assert sorted(map(tuple, hierarchy.overlaid(spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "id long, parent long"), edits).collect())) == [(1, None, True), (2, 3, True), (3, 1, False)]
