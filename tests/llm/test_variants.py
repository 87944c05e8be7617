"""Spelling variants against all pairs."""

from __future__ import annotations

import binascii
import random
import re
from collections import Counter

import pytest

from factloom.llm import variants
from factloom.llm.queries import queries


def _one(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def _plain(words: dict[str, int]) -> dict:
    near = {a: [b for b in words if _one(a, b)] for a in words}
    form = {}
    for a, bs in near.items():
        if bs:
            best = min(bs, key=lambda b: (-words[b], b))
            if words[best] >= 5 * words[a]:
                form[a] = best
    root = {}
    for a in words:
        r = a
        while r in form:
            r = form[r]
        root[a] = r
    return {a: (form.get(a), root[a], n, len(near[a]), words.get(form.get(a))) for a, n in words.items()}


def _got(df) -> dict:
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_equals_all_pairs(spark, sf_dir):
    counts = Counter()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = binascii.crc32(f"{r['doc_id']}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    assert _got(queries()["op12_spelling_variants"](spark, sf_dir)) == _plain(words)


@pytest.mark.parametrize("width", [1, 2, 5])
def test_part_equals_all_pairs(width):
    rnd = random.Random(width)
    for _ in range(200):
        texts = list({"".join(rnd.choice("abc") for _ in range(rnd.choice((width, width - 1)))) for _ in range(40)})
        for a, near in zip(texts, variants.near_in(texts, width), strict=True):
            assert sorted(near) == [k for k, b in enumerate(texts) if _one(a, b) and max(len(a), len(b)) == width]


@pytest.mark.parametrize("most", [1, 3, 2_000])
def test_parts_of_any_size_find_all(spark, most):
    """A third of the words share a prefix, another third a suffix, and some are runs of one letter, where the place of an edit is not told by the texts."""
    rnd = random.Random(9)
    words = {"common" + "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 5))) for _ in range(40)} | {"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 5))) + "common" for _ in range(40)}
    words |= {"a" * i + "b" * j for i in range(6) for j in range(6) if i + j > 0} | {"é" * i for i in range(6, 9)}
    counts = {w: rnd.choice((5, 6, 25, 30, 150, 800)) for w in sorted(words)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r["word"]: (r["n_near"], r["form"], r["form_n"]) for r in variants.near_words(df, most).collect()}
    want = {}
    for a in counts:
        near = [b for b in counts if _one(a, b)]
        if near:
            best = min(near, key=lambda b: (-counts[b], b))
            want[a] = (len(near), best, counts[best])
    assert got == want


def test_roots_follow_long_chains(spark):
    pairs = [(f"w{i}", f"w{i + 1}") for i in range(20)] + [(f"x{i}", "w3") for i in range(50)]
    got = {r["word"]: r["root"] for r in variants.roots(spark.createDataFrame(pairs, "word string, form string")).collect()}
    assert got == {a: "w20" for a, _ in pairs}


def test_edge_rows(spark):
    rows = [(1, None), (None, "colour " * 30), (2, "Colour colr ×÷×÷×÷ " * 5), (2, "Colour colr ×÷×÷×÷ " * 5), (3, "color" * 3000)]
    got = _got(variants.grouped(spark.createDataFrame(rows, "doc_id long, text string"), occurrences=1))
    assert got["colour"][2] == 40 and "colr" not in got and got["×÷×÷×÷"][2] == 10 and got["color" * 3000][2] == 1
    assert variants.grouped(spark.createDataFrame([], "doc_id long, text string")).count() == 0
