"""Retrieval scores all terms of a seed."""

from __future__ import annotations

import numpy as np

from factloom.llm import packing


def test_all_terms_rank():
    """Scores are BM25 over every term of the seed, and neighbours come in that order whole."""
    rnd = np.random.default_rng(2)
    docs = [np.append(rnd.zipf(1.3, 200).clip(1, 499), 0).astype("<u2") for _ in range(300)]
    df = np.bincount(np.concatenate([np.unique(x[:-1]) for x in docs]), minlength=500)
    idf, mean = np.log(1 + (300 - df + 0.5) / (df + 0.5)), 200.0
    index = packing.Index(docs, idf, mean)
    for seed in range(0, 300, 30):
        want = np.zeros(300)
        for j, x in enumerate(docs):
            tf = np.bincount(x[:-1], minlength=500)
            norm = packing.K1 * (1 - packing.B + packing.B * (len(x) - 1) / mean)
            want[j] = sum(idf[t] * tf[t] * (packing.K1 + 1) / (tf[t] + norm) for t in np.unique(docs[seed][:-1]) if tf[t])
        used = np.zeros(300, bool)
        used[seed] = True
        order = list(index.neighbours(seed, used))
        assert len(order) == 299 and sorted(order) == [j for j in range(300) if j != seed]
        assert np.all(np.diff(want[order]) < 1e-3)
