"""Repairs, matchings and flows: cases worked by hand and by brute force, for what SQL cannot state."""

from __future__ import annotations

import random
from itertools import combinations, permutations

import pytest

from factloom.operators import matching as m
from factloom.operators import repairs as r
from factloom.plans import catalog


def block(id_, kind="paragraph", text="x", page=0, x0=0.0, y0=0.0, x1=100.0, y1=10.0, level=1):
    return {"seq": id_, "id": id_, "kind": kind, "page_index": page, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "level": level, "text": text}


def ids(blocks):
    return [b["id"] for b in blocks]


def test_local_inversions():
    above, below, far, aside = block(3, y0=10, y1=20), block(1, y0=20, y1=30), block(2, y0=300, y1=310), block(4, x0=400, x1=500)
    assert ids(r.local_inversions([below, above])) == [3, 1]
    assert ids(r.local_inversions([far, above])) == [2, 3]  # more than three lines above
    assert ids(r.local_inversions([below, aside])) == [1, 4]  # another column
    assert ids(r.local_inversions([block(1, y0=20, y1=30), block(2, page=1)])) == [1, 2]


def test_anchored_inserts():
    a, b, rec, top, other = block(1, y0=100), block(2, y0=200), block(3, "list", y0=150), block(4, "list", y0=50), block(5, "list", page=7)
    assert ids(r.anchored_inserts([a, b, rec])) == [1, 3, 2]
    assert ids(r.anchored_inserts([a, b, top])) == [4, 1, 2]
    assert ids(r.anchored_inserts([a, b, other])) == [1, 2, 5]
    assert ids(r.anchored_inserts([block(1, y0=100), block(2, "list", y0=120), block(3, "list", y0=110)])) == [1, 3, 2]
    # two columns: what is nearer above in the other one is no anchor
    left, right, low = block(1, y0=100, x0=0, x1=40), block(2, y0=140, x0=60, x1=100), block(3, y0=300, x0=0, x1=40)
    assert ids(r.anchored_inserts([left, low, right, block(9, "list", y0=150, x0=5, x1=45)])) == [1, 9, 3, 2]
    assert ids(r.anchored_inserts([left, low, block(9, "list", y0=150, x0=200, x1=240)])) == [1, 9, 3] and ids(r.anchored_inserts([left, low, block(9, "list", y0=350, x0=200, x1=240)])) == [1, 3, 9]


def test_families_of_other_levels():
    got = r.template_family([block(1, "heading", level=1), block(2), block(3, "heading", level=7), block(4), block(5, "heading", level=None)])
    assert [b["kind"].split("/")[0] for b in got] == ["numbered", "numbered", "plain", "plain", "plain"]


def test_cross_page_tables():
    t = lambda i, page, **k: block(i, "table", f"t{i}", page, **k)
    got = r.cross_page_tables([t(1, 0), block(2), t(3, 1), t(4, 2, x0=3), t(5, 2), t(6, 3, level=2)])
    assert [(b["id"], b["text"]) for b in got] == [(1, "t1\nt3\nt4"), (2, "x"), (5, "t5"), (6, "t6")]


def test_rectangles():
    grid = [(i, j) for i in range(2) for j in range(2)]
    assert r.rectangles(grid, {(0, 0)}, set()) == [(0, 0, 1, 2, True), (1, 0, 1, 1, True), (1, 1, 1, 1, True)]
    assert r.rectangles(grid, {(0, 0)}, {(0, 1)}) == [(0, 0, 2, 2, False), (1, 0, 1, 1, True)]


def test_edges_notes_and_profiles():
    table, inside, beside = block(1, "table", "a b", x1=300, y1=50), block(2, text="a", x0=10), block(3, text="zz", x0=10)
    assert ids(r.edge_duplicates([table, inside, beside])) == [1, 3]
    notes = [block(1, text="1 one", y0=550), block(2, "list", "2 two", y0=580), block(3, text="3 x", y0=100)]
    assert [b["kind"] for b in r.bottom_notes(notes)] == ["footnote", "footnote", "paragraph"]
    assert [b["kind"] for b in r.bottom_notes([block(1, text="9 low", y0=700), block(2, text="4 lone", page=1, y0=550)])] == ["footnote", "paragraph"]
    falling = [block(1, text="2 two", y0=550), block(2, text="1 one", y0=580)]
    assert {b["kind"] for b in r.bottom_notes(falling)} == {"paragraph"}
    got = r.profile_tables([block(1, "table", "a"), block(2, "table", "b", page=1), block(3, "table", "c", page=3)])
    assert [(b["id"], b["text"]) for b in got] == [(1, "a\nb"), (3, "c")]


def test_paragraphs_sections_and_captions():
    got = r.paragraphs([block(1, text="it re-"), block(2, text="ports and", y0=12), block(3, text="ends.", y0=24), block(4, text="Next", y0=36)])
    assert [(b["id"], b["text"]) for b in got] == [(1, "it reports and ends."), (4, "Next")]
    got = r.inline_na([block(1, "heading", "Useful resources"), block(2, "heading", "N/A", level=2), block(3, text="N/A")])
    assert [(b["kind"], b["level"]) for b in got] == [("heading", 1), ("paragraph", None), ("paragraph", 1)]
    got = r.subheadings([block(1, "heading", level=2), block(2, text="Steps"), block(3, "list"), block(4, text="A sentence."), block(5, "list")])
    assert [(b["kind"], b["level"]) for b in got] == [("heading", 2), ("heading", 3), ("list", 1), ("paragraph", 1), ("list", 1)]
    got = r.captions([block(1, "table"), block(2, text="Table 3 shows"), block(3, text="Table 4", page=1)])
    assert [(b["kind"], b.get("parent")) for b in got] == [("table", None), ("caption", 1), ("paragraph", None)]


def test_hierarchies():
    got = r.list_hierarchy([block(1, "list", level=1), block(2, "list", level=3), block(3, "list", level=1), block(4), block(5, "list", level=2)])
    assert [(b["level"], b.get("parent")) for b in got] == [(1, None), (2, 1), (1, None), (1, None), (1, None)]
    got = r.heading_hierarchy([block(1), block(2, "heading", level=2), block(3), block(4, "heading", level=3), block(5), block(6, "heading", level=1), block(7)])
    assert [(b["id"], b.get("parent")) for b in got] == [(1, None), (2, None), (3, 2), (4, 2), (5, 4), (6, None), (7, 6)]
    assert [b["sibling"] for b in r.sibling_orders(got)] == [0, 1, 0, 1, 0, 2, 0]
    assert len(r.ASSEMBLY) == 11


def test_assembly_in_order():
    """A note at the bottom never takes in the paragraph of the next page, which then joins on."""
    page = [block(1, "heading", "Scope", level=3), block(2, text="Steps"), block(3, "list", "one"), block(4, text="1 See there", y0=700), block(5, text="goes", page=1), block(6, text="on.", page=1, y0=12)]
    for repair in r.ASSEMBLY:
        page = repair(page)
    assert [(b["id"], b["kind"], b.get("parent"), b["text"]) for b in page] == [(1, "heading", None, "Scope"), (2, "heading", 1, "Steps"), (3, "list", 2, "one"), (4, "footnote", 2, "1 See there"), (5, "paragraph", 2, "goes on.")]


@pytest.mark.parametrize("seed", range(40))
def test_matchings_and_flows_are_largest(seed):
    rnd = random.Random(seed)
    edges = sorted({(rnd.randrange(5), "abcde"[rnd.randrange(5)]) for _ in range(rnd.randrange(12))})
    got = m.largest_matching(edges)
    assert set(got.items()) <= set(edges) and len(set(got.values())) == len(got)
    best = max((k for k in range(6) for c in combinations(edges, k) if len({a for a, _ in c}) == len({b for _, b in c}) == k), default=0)
    assert len(got) == best
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
    demand, supply = {a: rnd.randint(1, 3) for a in range(5)}, {b: rnd.randint(1, 3) for b in "abcde"}
    units = [(a, b) for a in demand for _ in range(demand[a]) for b in [0]]
    cut = min(sum(demand[a] for a in demand if a not in s) + sum(supply[b] for b in supply if any(b in near.get(a, ()) for a in s)) for k in range(6) for s in combinations(range(5), k))
    assert m.largest_flow(demand, supply, near) == cut <= len(units)


def test_long_augmenting_paths():
    n = 3000
    edges = [(i, j) for i in range(n) for j in (i, i + 1) if j < n]
    assert len(m.largest_matching([(n, 0), *edges])) == n
    assert m.largest_flow({i: 1 for i in range(n)}, {i: 1 for i in range(n)}, {i: [(i + 1) % n, i] for i in range(n)}) == n


def test_nearest_takes_each_once(spark):
    rnd = random.Random(1)
    left = [(1, i, float(rnd.randrange(100)), float(rnd.randrange(100)), i) for i in range(6)]
    right = [(1, 100 + i, float(rnd.randrange(100)), float(rnd.randrange(100)), i) for i in range(5)]
    a = spark.createDataFrame(left, "k int, id long, x0 double, y0 double, i int")
    b = spark.createDataFrame(right, "k int, o_id long, ox double, oy double, oi int")
    free, want = list(right), {}
    for _, id_, x, y, i in left:
        if free:
            best = min(free, key=lambda o: (abs(x - o[2]) + 2 * abs(y - o[3]) + 2 * abs(i - o[4]), o[4], o[1]))
            want[id_] = best[1]
            free.remove(best)
    assert {row["id"]: row["o_id"] for row in m.nearest_one_to_one(a, b, ["k"]).collect()} == want
    assert permutations  # the greedy choice is not the cheapest of all


def plain(name, spark, sf_dir):
    """The query's rows by its rule over collected blocks, one document after another."""
    rows = catalog.Tables(spark, sf_dir).blocks.collect()
    docs: dict = {}
    for b in sorted(rows, key=lambda b: (b["document_id"], b["seq"])):
        docs.setdefault(b["document_id"], []).append(b.asDict())
    return {(d, b["id"], i) for d, items in docs.items() for i, b in enumerate(name([x for x in items]))}


@pytest.mark.parametrize(("query", "rules"), [("s2_6_9_local_inversions", [r.local_inversions]), ("s2_6_11_anchored_inserts", [r.anchored_inserts]), ("s2_6_22_assembly_order", r.ASSEMBLY)])
def test_queries_of_repairs(query, rules, spark, sf_dir):
    def whole(items):
        for rule in rules:
            items = rule(items)
        return items

    got = {(x["document_id"], x["id"], x["place"]) for x in catalog.queries()[query](spark, sf_dir).collect()}
    assert got == plain(whole, spark, sf_dir)


def test_queries_change_something(spark, sf_dir):
    """None of the repairs leaves every block where it was."""
    blocks = catalog.Tables(spark, sf_dir).blocks.select("document_id", "id", "seq")
    for name in ("s2_6_9_local_inversions", "s2_6_11_anchored_inserts"):
        got = catalog.queries()[name](spark, sf_dir)
        assert got.join(blocks, ["document_id", "id"]).where("place <> seq - 1").count() > 0
    kinds = {x["kind"] for x in catalog.queries()["s2_6_22_assembly_order"](spark, sf_dir).where("parent is not null").collect()}
    assert {"paragraph", "list", "table"} <= kinds
    assert catalog.queries()["s2_6_3_cross_page_tables"](spark, sf_dir).count() < blocks.count()


def test_flow_query(spark, sf_dir):
    got = catalog.queries()["s2_4_18_maximum_flow"](spark, sf_dir)
    assert got.where("required <> matched + missing or matched < 0").count() == 0 and got.where("matched > 0 and missing > 0").count() > 0


def test_merged_cells_query(spark, sf_dir):
    """Each document's rectangles hold its cells once, by another count of components."""
    got = catalog.queries()["s2_8_16_merged_cells"](spark, sf_dir).collect()
    cells: dict = {}
    for b in catalog.Tables(spark, sf_dir).blocks.collect():
        cells.setdefault(b["document_id"], {})[(b["seq"] - 1) // 3, (b["seq"] - 1) % 3] = b["id"] % 4
    parts: dict = {}
    for x in got:
        parts[x["document_id"]] = parts.get(x["document_id"], 0) + 1
    for d, held in cells.items():
        joins = [(c, (c[0], c[1] + 1)) for c, k in held.items() if k == 0] + [(c, (c[0] + 1, c[1])) for c, k in held.items() if k == 1]
        groups = [{c} for c in held]
        for a, b in joins:
            if b in held:
                one, two = (next(g for g in groups if x in g) for x in (a, b))
                if one is not two:
                    groups.remove(two)
                    one |= two
        assert parts[d] == len(groups)
