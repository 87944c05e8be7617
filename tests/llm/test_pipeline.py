"""Each stage of the pipeline against a plain version of it, on what its predecessor kept."""

from __future__ import annotations

from collections import defaultdict

import numpy as np

import corpus_pipeline as cp
from factloom.llm import langid, line_dedup, quality
from factloom.llm.common import documents, labels, written
from tests.llm.test_near import roots_of


def plain_lines(rows):
    sites, first = defaultdict(set), {}
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            k = line.strip(" ")
            if k:
                if r["source"] is not None:
                    sites[k].add(r["source"])
                first[k] = min(first.get(k, r["doc_id"]), r["doc_id"])
    out = {}
    for r in rows:
        kept, seen = [], set()
        for line in (r["text"] or "").split("\n"):
            k = line.strip(" ")
            if len(sites.get(k, ())) < line_dedup.SITES or first[k] == r["doc_id"] and k not in seen:
                kept.append(line)
            seen.add(k)
        out[r["doc_id"]] = "\n".join(kept)
    return out


def test_stages(spark, sf_dir):
    stages = dict(cp.STAGES)
    docs = documents(spark, sf_dir)
    rows = docs.collect()
    step = lambda name, d: written(stages[name](spark, d, sf_dir), name)

    told = step("language", docs)
    model = langid.train(docs)
    assert {r["doc_id"] for r in told.collect()} == {r["doc_id"] for r in rows if (p := model.predict(r["text"]))[0] != "und" and p[1] >= model.threshold}

    good = step("quality", told)
    judge = quality.train(told, labels(spark, sf_dir))
    keep = set()
    for r in told.collect():
        p = -judge.tokens(r["text"])
        z, t = judge.excess(r["lang"], len(p), float(np.mean(p)))
        if z <= t:
            keep.add(r["doc_id"])
    assert {r["doc_id"] for r in good.collect()} == keep

    lines = step("lines", good)
    got = {r["doc_id"]: r for r in lines.collect()}
    assert {i: r["text"] for i, r in got.items()} == plain_lines(good.collect())
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())

    distinct = step("near_duplicates", lines)
    found = roots_of({i: r["text"] for i, r in got.items()})
    kept = {r["doc_id"]: r for r in distinct.collect()}
    assert set(kept) == set(found.values()) and all(kept[i] == got[i] for i in kept)

    pieces = stages["packing"](spark, distinct, sf_dir).collect()
    held = defaultdict(int)
    for r in pieces:
        assert len(r["ids"]) == 4 * r["length"]
        held[r["doc_id"]] += r["length"]
    assert set(held) == set(kept) and all(held[r["doc_id"]] == r["doc_tokens"] for r in pieces)
    assert cp.run(spark, sf_dir).count() == len(pieces)


def test_shape():
    assert [n for n, _ in cp.STAGES] == ["language", "quality", "lines", "near_duplicates", "packing"] and cp.ORACLE_SQL is None
