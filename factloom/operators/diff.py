"""Differences of two versions: an edit script over words, and the passages that have moved."""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PIECE = re.compile(r"\w+|\s+|[^\w\s]")

Run = tuple[str, int, int, int, int]


def pieces(text: str) -> list[str]:
    """Words, marks and white space, which together are the text."""
    return _PIECE.findall(text)


def _forward(a: list, b: list) -> tuple[int, list[dict[int, int]]]:
    """The least number of insertions and deletions, and for each number of them how far each diagonal reached before it."""
    n, m, reach, trace = len(a), len(b), {1: 0}, []
    for d in range(n + m + 1):
        trace.append(dict(reach))
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if k == -d or (k != d and reach[k - 1] < reach[k + 1]) else reach[k - 1] + 1
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            reach[k] = x
            if x >= n and x - k >= m:
                return d, trace
    raise AssertionError("no path")


def matches(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs (i, j) with a[i] == b[j] of a longest common subsequence. Common ends are set aside first; the rest takes time in its length by the number of its edits."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [(i, i) for i in range(head)] + [(len(a) - i, len(b) - i) for i in range(tail, 0, -1)]
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if a and b:
        d, trace = _forward(a, b)
        x, y, middle = len(a), len(b), []
        for step in range(d, -1, -1):
            reach, k = trace[step], x - y
            before = k + 1 if k == -step or (k != step and reach[k - 1] < reach[k + 1]) else k - 1
            px = reach[before] if step else 0
            py = px - before if step else 0
            while x > px and y > py and a[x - 1] == b[y - 1]:
                x, y = x - 1, y - 1
                middle.append((head + x, head + y))
            if step:
                x, y = px, py
        out[head:head] = middle[::-1]
    return out


def script(old: str, new: str) -> list[Run]:
    """(op, old start, old end, new start, new end) in code points: runs of keep, delete and insert that lead from one text to the other, deletions before insertions."""
    a, b = pieces(old), pieces(new)
    at_a, at_b = [0], [0]
    for at, parts in ((at_a, a), (at_b, b)):
        for p in parts:
            at.append(at[-1] + len(p))
    out: list[Run] = []

    def add(op: str, i: int, i2: int, j: int, j2: int) -> None:
        if i == i2 and j == j2:
            return
        if out and out[-1][0] == op:
            op, x, _, y, _ = out.pop()
        else:
            x, y = at_a[i], at_b[j]
        out.append((op, x, at_a[i2], y, at_b[j2]))

    i = j = 0
    for x, y in [*matches(a, b), (len(a), len(b))]:
        add("delete", i, x, j, j)
        add("insert", x, x, j, y)
        if x < len(a):
            add("keep", x, x + 1, y, y + 1)
        i, j = x + 1, y + 1
    return out


def replay(old: str, new: str, runs: list[Run]) -> str:
    """The new text from the old one and what the script inserts."""
    return "".join(old[a:b] if op == "keep" else new[c:d] if op == "insert" else "" for op, a, b, c, d in runs)


SCRIPT = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), *(T.StructField(n, T.IntegerType()) for n in ("old_start", "old_end", "new_start", "new_end"))]))


def edit_script(old: Column, new: Column) -> Column:
    """The script of two text columns; a null text counts as empty, and equal texts are one kept run."""

    @F.pandas_udf(SCRIPT)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(SCRIPT.elementType.names, r, strict=True)) for r in script(x or "", y or "")] for x, y in zip(a, b, strict=True)], dtype=object)

    return run(old, new)


def stays(order: list[int]) -> list[bool]:
    """Which elements belong to a longest increasing subsequence: the others are the fewest that must have moved."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(order)
    for i, x in enumerate(order):
        k = bisect_left(tops, x)
        before[i] = at[k - 1] if k else -1
        tops[k : k + 1], at[k : k + 1] = [x], [i]
    out, i = [False] * len(order), at[-1] if at else -1
    while i >= 0:
        out[i], i = True, before[i]
    return out


def passages(saved: DataFrame, local: DataFrame, document: str, passage: str, order: str, text: str) -> DataFrame:
    """(document, passage, change, moved, old, new): each passage of two versions as added, removed, changed or same, moved where it is one of the fewest survivors
    that must have left their order. Passages are matched by id in one shuffle; places are folded for each document, texts are not."""
    side = lambda df, s: df.select(document, passage, F.struct(F.col(order).alias("at"), F.col(text).alias("text")).alias(s))
    both = side(saved, "old").join(side(local, "new"), [document, passage], "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old.text").eqNullSafe(F.col("new.text")), "changed").otherwise("same")
    places = both.where("old is not null and new is not null").groupBy(document).agg(F.array_sort(F.collect_list(F.struct(F.col("old.at").alias("o"), F.col("new.at").alias("n"), F.col(passage).alias("id")))).alias("p"))

    @F.pandas_udf(T.ArrayType(T.BooleanType()))
    def kept(order: pd.Series) -> pd.Series:
        return pd.Series([stays(list(x)) for x in order], dtype=object)

    ids = places.withColumn("k", kept(F.transform("p", lambda x: x["n"].cast("long")))).select(document, F.explode(F.arrays_zip(F.transform("p", lambda x: x["id"]).alias("id"), F.col("k"))).alias("z"))
    moved = ids.where("not z.k").select(document, F.col("z.id").alias(passage), F.lit(True).alias("moved"))
    return both.join(moved, [document, passage], "left").select(document, passage, change.alias("change"), F.coalesce("moved", F.lit(False)).alias("moved"), F.col("old.text").alias("old"), F.col("new.text").alias("new"))
