"""A window of a sheet is read without sorting the sheet."""

from __future__ import annotations

from factloom.plans import catalog


def test_no_sheet_is_sorted(spark, sf_dir):
    df = catalog.queries()["s2_1_18_windowed_reader"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "MapInArrow" in plan
