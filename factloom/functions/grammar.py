"""Phrases over words: small rules that are put together and looked for from left to right.

A rule takes the words of a text and a place among them, and gives the place after its phrase, or -1 where it does not stand there.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

_WORD = re.compile(r"\w+|[^\w\s]|\n")


class Word(NamedTuple):
    low: str
    start: int
    end: int


Rule = Callable[[list[Word], int], int]


def read(text: str) -> list[Word]:
    """Words, marks and line ends, with their places in code points."""
    return [Word(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


def phrase(*phrases: str) -> Rule:
    """One of the phrases, each of one or more words; the longest that stands there."""
    known: dict[str, list[tuple[str, ...]]] = defaultdict(list)
    for p in sorted((tuple(w.low for w in read(p)) for p in phrases), key=len, reverse=True):
        known[p[0]].append(p)

    def rule(words: list[Word], i: int) -> int:
        if i < len(words):
            for p in known.get(words[i].low, ()):
                if len(p) == 1 or tuple(w.low for w in words[i : i + len(p)]) == p:
                    return i + len(p)
        return -1

    return rule


def where(test: Callable[[str], bool]) -> Rule:
    """One word that passes a test."""
    return lambda words, i: i + 1 if i < len(words) and test(words[i].low) else -1


def then(*rules: Rule) -> Rule:
    def rule(words: list[Word], i: int) -> int:
        for r in rules:
            i = r(words, i)
            if i < 0:
                break
        return i

    return rule


def either(*rules: Rule) -> Rule:
    """The first of the rules that holds."""
    return lambda words, i: next((j for r in rules if (j := r(words, i)) >= 0), -1)


def maybe(rule: Rule) -> Rule:
    return lambda words, i: max(rule(words, i), i)


def found(rule: Rule, words: list[Word]) -> Iterator[tuple[int, int]]:
    """(first, after) of the phrase wherever it stands, from left to right and without overlap."""
    i = 0
    while i < len(words):
        j = rule(words, i)
        if j > i:
            yield i, j
            i = j
        else:
            i += 1


def span(text: str, words: list[Word], i: int, j: int) -> dict:
    a, b = words[i].start, words[j - 1].end
    return {"start": a, "end": b, "text": text[a:b]}
