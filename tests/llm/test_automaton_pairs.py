"""Every pair of words is a state, however rare it is in a large corpus."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest

from factloom.llm import lm


def _plain(texts: list[str]) -> list[float]:
    seen, follow = Counter(), defaultdict(Counter)
    words = [["<s>", *x.split(), "</s>"] for x in texts]
    for w in words:
        seen.update(w[1:])
        for k in range(1, len(w)):
            follow[w[k - 1],][w[k]] += 1
            if k > 1:
                follow[w[k - 2], w[k - 1]][w[k]] += 1
    n, v = sum(seen.values()), len(seen)

    def p(h, w):
        if not h:
            return (seen[w] + 0.1) / (n + 0.1 * (v + 1))
        f = follow[h]
        return (f[w] + len(f) * p(h[1:], w)) / (sum(f.values()) + len(f)) if f else p(h[1:], w)

    return [sum(math.log10(p(tuple(w[max(0, k - 2) : k]), w[k])) for k in range(1, len(w))) for w in words]


@pytest.mark.parametrize("batch_bytes", [8 << 20, 30_000])
def test_rare_pairs_are_states(batch_bytes, spark):
    # 150,000 tokens, so that a bound of one in 50,000 would ask for three of a pair
    texts = [*("of the one and the other " * 3_000 for _ in range(8)), "a rare pair goes on", "rare pair goes on", "the pair goes off", "rare pair"]
    got = lm.scored(spark.createDataFrame([(i, x, True) for i, x in enumerate(texts)], "doc_id long, text string, learned boolean"), batch_bytes).collect()
    assert {r["doc_id"]: r["score"] for r in got} == pytest.approx(dict(enumerate(_plain(texts))), rel=1e-9)
