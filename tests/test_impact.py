from __future__ import annotations

from factloom.operators import graph as g


def test_reach_goes_on_both_ways(spark):
    """A chain with turns of direction, a cycle, and a part that no seed touches."""
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (5, 4), (4, 3), (8, 9)], "src long, dst long")
    got = g.reach(spark.createDataFrame([(1,), (7,)], "id long"), edges)
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 3, 4, 5, 7]
