"""Texts of pages that belong to no chapter, paragraph, list, table or footnote, told in one way through a page."""

from __future__ import annotations

from factloom.sources import html

PAGES = [
    (1, "<body><div class='footnote'>a<p>b<i>c</i></p><ol><li>d<b>e</b></li></ol>f<span>g</span></div><p>h<b>i</b></p></body>"),
    (2, "<body>a<h2>b<i>c</i></h2><p class='x paragraph'>d</p><p>e</p><td>f</td><script>g</script><div>h<div>i</div></div></body>"),
    (3, "<html><head><title>t</title></head><body>" + "".join(f"<p>{i}</p><ul><li>x<span>y</span></li></ul>" for i in range(12)) + "</body></html>"),
    (4, "<p>outside</p>"),
    (5, ""),
]


def test_texts_below_nested_stands(spark):
    found = html.nodes(spark.createDataFrame(PAGES, "page_id long, html string"))
    assert sorted(tuple(r) for r in html.chapters(found).collect()) == [(1, 0, 0, 2), (2, 1, 1, 4), (3, 0, 0, 12), (4, 0, 0, 0)]


def test_pages_are_read_once_and_never_broadcast(spark):
    found = html.nodes(spark.createDataFrame(PAGES, "page_id long, html string"))
    plan = html.chapters(found)._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("ArrowEvalPython") == 1 and "Broadcast" not in plan
