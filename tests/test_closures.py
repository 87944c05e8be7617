"""The closing queries go further than one step."""

from __future__ import annotations

import pytest

from factloom.plans import catalog


@pytest.mark.parametrize(("name", "far"), [("s2_8_14_ancestor_distance", "depth > 1"), ("s2_8_28_context_closure", "refs > 0")])
def test_far(name, far, spark, sf_dir):
    assert not catalog.queries()[name](spark, sf_dir).where(far).isEmpty()
