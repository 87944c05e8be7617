"""One rule for thresholds at every size: what a language says counts as its documents are many."""

from __future__ import annotations

import numpy as np
import pandas as pd

from factloom.llm import quality


def _seen(n: int, lang: str, mean: float, rng: np.random.Generator) -> pd.DataFrame:
    means = rng.normal(mean, 0.05, n)
    return pd.DataFrame({"lang": lang, "n": 200, "mean": means, "square": means**2 + 0.3})


def test_thresholds_are_continuous_in_the_sample():
    rng = np.random.default_rng(1)
    most = _seen(2000, "a", 2.0, rng)
    other = _seen(400, "b", 2.5, rng)
    before = quality._thresholds(most)[None]
    for n in (1, 5, 20, 39, 40, 41, 100, 249, 250, 251, 399):
        now = quality._thresholds(pd.concat([most, other[:n]]))["b"]
        more = quality._thresholds(pd.concat([most, other[: n + 1]]))["b"]
        # one document more never makes more than a small step
        assert all(abs(x - y) <= 0.2 * max(1.0, abs(x)) for x, y in zip(now, more, strict=True))
    few, many = (quality._thresholds(pd.concat([most, other[:n]]))["b"] for n in (1, 400))
    assert abs(few[0] - before[0]) < 0.05 and abs(many[0] - 2.5) < 0.08


def test_a_single_outlier_does_not_set_the_threshold():
    rng = np.random.default_rng(2)
    seen = _seen(1000, "a", 2.0, rng)
    odd = seen.copy()
    odd.loc[odd.index[0], "mean"] = 9.0
    assert abs(quality._thresholds(odd)["a"][3] - quality._thresholds(seen)["a"][3]) < 0.5


def test_no_language_and_one_document():
    rng = np.random.default_rng(3)
    got = quality._thresholds(pd.concat([_seen(3, None, 2.0, rng), _seen(1, "x", 2.2, rng)]))
    assert set(got) == {None, "x"} and all(np.isfinite(v).all() for v in got.values())
