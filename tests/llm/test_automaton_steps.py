"""A long text is read in stretches side by side, with the scores of one that is read from end to end."""

from __future__ import annotations

import random

import pytest

from factloom.llm import lm


def _texts() -> list[str]:
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefgh", k=3)) for _ in range(60)]
    return [*(" ".join(rnd.choices(words, k=k)) for k in (5_000, 1, 2, 255, 256, 257, 258, 513)), "", None, "abc new words abc"]


def _read(texts, monkeypatch, **how):
    local, calls, plain = lm.Local(texts, [True] * 10 + [False], None), [], lm.Automaton.read
    types = lm.np.bincount(local.grams[local.gram_count > 0] // local.n, minlength=len(local.contexts))
    a, start = lm.automaton(local, 1, int(local.count.sum()), local.n, local.count, types, local.gram_count)
    monkeypatch.setattr(lm.Automaton, "read", lambda *x: calls.append(1) or plain(*x))
    out = a.scores(local.seq, local.first, local.lengths, start, **how)
    monkeypatch.undo()
    return out.tolist(), len(calls)


def test_steps_do_not_grow_with_the_longest_text(monkeypatch):
    got, steps = _read(_texts(), monkeypatch)
    assert steps < 300 and len(got) == 11


@pytest.mark.parametrize("stretch", [1, 2, 3, 7, 256])
def test_stretches_score_as_whole_texts(stretch, monkeypatch):
    whole, steps = _read(_texts(), monkeypatch, stretch=1 << 30)
    assert steps == 5_001
    assert _read(_texts(), monkeypatch, stretch=stretch)[0] == pytest.approx(whole, rel=1e-12)
