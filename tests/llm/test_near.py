"""Near copies of the pipeline against all pairs compared exactly."""

from __future__ import annotations

import random
from collections import defaultdict
from itertools import combinations

import pytest

import corpus_pipeline as cp
from factloom.llm import near
from tests.llm.test_brute import _components


def _shingles(x):
    w = x.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _jaccard(a, b):
    a, b = _shingles(a), _shingles(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def roots_of(texts):
    """The smallest id that links of a Jaccard similarity of 0.8 or more reach, by comparing all pairs that share a shingle."""
    sets, held = {i: _shingles(x) for i, x in texts.items()}, defaultdict(list)
    for i, s in sorted(sets.items()):
        for x in s or {()}:
            held[x].append(i)
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in {p for ids in held.values() for p in combinations(ids, 2)}:
        if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def _edited(rnd, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rnd.randrange(len(words))] = f"new{rnd.randrange(10**6)}"
    return words


def _texts(families=30, copies=6):
    """Families of 200 words with none to eight words of each copy changed: similarities from 0.5 to 1."""
    rnd, out = random.Random(11), []
    for _ in range(families):
        base = [f"w{rnd.randrange(2000)}" for _ in range(200)]
        out += [" ".join(_edited(rnd, base, k)) for k in range(copies)] + [" ".join(_edited(rnd, base, 8))]
    return out


def _roots(texts):
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    near_pairs = [(i, j) for i, j in combinations(range(len(texts)), 2) if i // 7 == j // 7 and _jaccard(texts[i], texts[j]) >= 0.8]
    for i, j in near_pairs:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return near_pairs, [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("few", [16, 2])
def test_near_copies(few, spark, monkeypatch):
    monkeypatch.setattr(near, "FEW", few)
    monkeypatch.setattr(near, "PIVOTS", 1)
    texts = _texts()
    pairs, roots = _roots(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in cp.distinct(spark, docs, "").collect()}
    want = set(roots)
    assert len(pairs) > 150 and len(kept ^ want) <= 0.02 * len(want)
    # the rule of four bits leaves many of these copies in the corpus
    from tests.llm.test_brute import _fingerprint

    assert len(set(_components({i: _fingerprint(x) for i, x in enumerate(texts)}).values())) > 1.2 * len(want)


def test_bands_recall():
    """Pairs of 0.8 and more that share a band, and none that is not alike passes."""
    texts = _texts(60)
    bands = [set(near.signature(x)[1]) for x in texts]
    pairs = [(i, j) for i, j in combinations(range(len(texts)), 2) if i // 7 == j // 7]
    close = [p for p in pairs if _jaccard(*(texts[i] for i in p)) >= 0.8]
    assert sum(bool(bands[i] & bands[j]) for i, j in close) >= 0.99 * len(close)
    assert all(near.alike(near.shingles(texts[i]), near.shingles(texts[j])) == ((i, j) in set(close)) for i, j in pairs[:300])
