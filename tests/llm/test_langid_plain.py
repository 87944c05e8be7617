"""Language identification against plain loops: subwords, one epoch of training, and a prediction."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np

from factloom.llm import langid


def _plain_buckets(text: str) -> list[int]:
    """Byte n-grams of the words by their definition, hashed by hand in 32 bits."""
    words, word = [], bytearray()
    for b in text.lower().encode():
        if 97 <= b <= 122 or b >= 128:
            word.append(b)
        elif word:
            words.append(bytes(word))
            word = bytearray()
    if word:
        words.append(bytes(word))
    data = b" " + b" ".join(words) + b" "
    out = []
    for n in langid.SUBWORDS:
        for i in range(len(data) - n + 1):
            h = n * 0x9E3779B1 & 0xFFFFFFFF
            for b in data[i : i + n]:
                h = ((h ^ b) * 0x01000193) & 0xFFFFFFFF
                h ^= h >> 15
            out.append(h % langid.BUCKETS)
    return out


def test_subwords():
    for text in ("The cat, the HAT!", "Straße 12 ÉTÉ", "日本", "a", "...", "x" * 300):
        assert sorted(langid.subwords(text).tolist()) == sorted(_plain_buckets(text))


def test_scores_by_loops():
    rng = np.random.default_rng(3)
    model = langid.Model(["aa", "bb", "cc"], rng.normal(size=(langid.BUCKETS, 4)).astype(np.float32), 0.37, 0.5, 0.02)
    for text in ("hello there", "ça va très bien " * 50, "q"):
        at = _plain_buckets(text)
        z = [sum(float(model.logits[b, k]) for b in at) / len(at) / model.temperature for k in range(4)]
        e = [math.exp(x - max(z)) for x in z]
        p = [(1 - model.noise) * x / sum(e) + model.noise / 4 for x in e]
        assert np.allclose(model.scores(text), p, atol=1e-5)
        lang, score = model.predict(text)
        best = max(range(3), key=lambda k: p[k])
        assert lang == model.langs[best] and abs(score - p[best]) < 1e-5


def test_training_by_loops(monkeypatch):
    """One epoch over a few texts, each step written out: the mean of the subwords' rows, softmax, and both gradients."""
    monkeypatch.setattr(langid, "EPOCHS", 1)
    rows = [("the cat sat", "en"), ("der hund lief", "de"), ("the dog ran", "en"), ("die katze kam", "de"), ("a bird flew", "en"), ("ein vogel", "de")]
    model = langid.fit(rows, seed=5)

    langs, rng = ["de", "en"], np.random.default_rng(5)
    shuffled = [rows[i] for i in rng.permutation(len(rows))]
    seen = []
    for i, (x, y) in enumerate(shuffled):
        b = langid.letters(x)
        seen.append((b, langs.index(y)))
        if i % 2 == 0:
            seen.append((langid.noise_like(b, rng), 2))
    data = [(Counter(langid.buckets(b).tolist()), y) for b, y in seen]
    cut = len(data) * 4 // 5
    dim = langid.DIM
    init = rng.uniform(-1 / dim, 1 / dim, (langid.BUCKETS, dim)).astype(np.float32)
    e = {b: [float(v) for v in init[b]] for counts, _ in data for b in counts}
    w = [[0.0] * 3 for _ in range(dim)]
    for step, i in enumerate(rng.permutation(cut)):
        counts, y = data[i]
        total = sum(counts.values())
        h = [sum(n / total * e[b][d] for b, n in counts.items()) for d in range(dim)]
        z = [sum(h[d] * w[d][k] for d in range(dim)) for k in range(3)]
        p = [math.exp(v - max(z)) for v in z]
        p = [v / sum(p) for v in p]
        p[y] -= 1
        rate = langid.RATE * (1 - step / cut)
        back = [sum(w[d][k] * p[k] for k in range(3)) for d in range(dim)]
        for d in range(dim):
            for k in range(3):
                w[d][k] -= rate * h[d] * p[k]
        scale = math.sqrt(rate * len(counts))
        for b, n in counts.items():
            for d in range(dim):
                e[b][d] -= scale * n / total * back[d]
    for b, row in e.items():
        want = [sum(row[d] * w[d][k] for d in range(dim)) for k in range(3)]
        assert np.allclose(model.logits[b], want, atol=1e-4)
