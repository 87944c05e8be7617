"""Personal data: patterns against their plain definition, the field against enumeration, and what both find."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from factloom.llm import pii
from factloom.llm.queries import queries

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _plain(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False, "card": 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(PLAIN).index(s[0])))


@pytest.fixture(scope="module")
def field(spark):
    return pii.train(pii.labelled(spark))


def test_patterns_equal_their_definition():
    rnd = random.Random(4)
    alphabets = ["a.@-1 é", "0123456789. -", "+1( )-.9a", "1234.255+@ -", "4242 4242-"]
    for k in range(6000):
        text = "".join(rnd.choice(alphabets[k % 5]) for _ in range(rnd.randint(0, 40)))
        assert pii.base(text) == _plain(text), text


def test_patterns_are_linear():
    for text in ("x" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" + " " * 300_000, "1 -" * 100_000):
        pii.base(text)
        pii.zones(text)


def test_query_holds_all_base_spans(spark, sf_dir):
    rows = {r["doc_id"]: r for r in queries()["op13_personal_data"](spark, sf_dir).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        want, r = _plain(text), rows[i]
        listed = [":".join(map(str, s)) for s in want]
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in want) for k in PLAIN]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(filter(None, r["spans"].split(","))) and len(r["spans"].split(",")) - (r["spans"] == "") == len(listed) + r["n_added"]


def _score(field, types, labels) -> float:
    e = pii._emitted(field.emissions, np.array(types))
    return sum(float(e[k, y]) for k, y in enumerate(labels)) + sum(float(field.moves[a, b]) for a, b in itertools.pairwise(labels))


def test_viterbi_equals_enumeration(field):
    rnd, n = random.Random(5), len(pii.LABELS)
    chains = [[rnd.randrange(field.emissions.shape[1]) for _ in range(k)] for k in (1, 3, 2, 4, 3)]
    for chain, got in zip(chains, field.decode(chains), strict=True):
        best = max((x for x in itertools.product(range(n), repeat=len(chain)) if x[0] not in pii._INSIDE), key=lambda x: _score(field, chain, x))
        assert abs(_score(field, chain, best) - _score(field, chain, got.tolist())) < 1e-3


def test_expectations_equal_enumeration():
    rng, n = np.random.default_rng(6), len(pii.LABELS)
    scores, moves = rng.normal(size=(2, 3, n)), np.where(pii._ALLOWED, rng.normal(size=(n, n)), pii._NEVER)
    held = np.array([[True, True, True], [True, True, False]])
    each, pairs = pii._expected(scores, moves, held)
    want_each, want_pairs = np.zeros_like(each), np.zeros_like(pairs)
    for i, m in enumerate((3, 2)):
        paths = [x for x in itertools.product(range(n), repeat=m) if x[0] not in pii._INSIDE]
        w = np.exp([sum(scores[i, k, y] for k, y in enumerate(x)) + sum(moves[a, b] for a, b in itertools.pairwise(x)) for x in paths])
        for x, p in zip(paths, w / w.sum(), strict=True):
            for k, y in enumerate(x):
                want_each[i, k, y] += p
            for a, b in itertools.pairwise(x):
                want_pairs[a, b] += p
    assert np.allclose(each, want_each) and np.allclose(pairs, want_pairs)


#: Sentences that the labelled table does not have.
UNSEEN = (
    ("You may call 212-555-0143 until nine.", ["phone:212-555-0143"]),
    ("Tel 0049 30 901820 is the desk", ["phone:0049 30 901820"]),
    ("blocked 10[.]2[.]3[.]4 again", ["ip:10[.]2[.]3[.]4"]),
    ("mail kim (at) foo (dot) com please", ["email:kim (at) foo (dot) com"]),
    ("My card 4111 2222 3333 4444 is lost", ["card:4111 2222 3333 4444"]),
    ("Mr. Paul Newman came", ["name:Paul Newman"]),
    ("Des +1 (826) 555-4081 190.137.223.204 du", ["phone:+1 (826) 555-4081", "ip:190.137.223.204"]),
    ("born 12.03.1987 in Oslo, no. 4711", []),
    ('key = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6" and 40 more', []),
    ("serial 1234567890123456 of 2019", []),
    ("On page 12 of version 3.1 the 7 rules", []),
)


@pytest.mark.parametrize(("text", "want"), UNSEEN)
def test_unseen_sentences(text, want, field):
    assert [f"{k}:{text[a:b]}" for k, a, b, _ in pii.spans([text], field)[0]] == want


def test_folds_of_the_table(spark):
    """Trained on two thirds, the field finds half of the last third's spans and little else."""
    rows = pii.labelled(spark).collect()
    hit = said = there = 0
    for fold in range(3):
        field = pii.train(spark.createDataFrame([r for i, r in enumerate(rows) if i % 3 != fold], "text string, spans array<struct<kind: string, start: int, end: int>>"))
        for i, r in enumerate(rows):
            if i % 3 == fold:
                want = {(s["kind"], s["start"], s["end"]) for s in r["spans"]}
                got = {(k, a, b) for k, a, b, fixed in pii.spans([r["text"]], field)[0] if not fixed}
                hit, said, there = hit + len(want & got), said + len(got), there + len(want)
    assert hit >= 0.45 * there and hit >= 0.75 * said


def test_edge_rows(spark, field):
    rows = [(1, None), (2, ""), (3, "Call (437) 555-0689 or mail a@b.co now"), (None, "a@b.co"), (4, "é🙂 1.2.3.4 " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", pii.F.lit("clash"))
    got = {r["doc_id"]: r for r in pii.masked(pii.found(docs, field)).collect()}
    assert got[1]["text"] is None and got[1]["pii"] == [] and got[2]["text"] == "" and got[None]["text"] == "<email>"
    assert got[3]["text"] == "Call <phone> or mail <email> now" and got[3]["start"] == "clash"
    assert len(got[4]["pii"]) == 20_000 and got[4]["text"] == "é🙂 <ip> " * 20_000
    none = pii.train(spark.createDataFrame([], "text string, spans array<struct<kind: string, start: int, end: int>>"))
    assert pii.spans(["call (437) 555-0689 or a@b.co", ""], none) == [[("email", 23, 29, True)], []]
