"""Windows of one topic where the index has many shards."""

from __future__ import annotations

import random
from collections import defaultdict

from factloom.llm import packing


def test_many_shards_keep_topics(spark):
    """Twelve topics over shards of about a twelfth: documents of one topic share windows, as do exact copies."""
    rnd = random.Random(4)
    alphabet = "abcdefghijklmnop"
    topics = [["".join(rnd.choice(alphabet) for _ in range(5)) for _ in range(30)] for _ in range(12)]
    rows = [(i, " ".join(rnd.choice(topics[i % 12]) for _ in range(30))) for i in range(1200)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), window=512, shard_tokens=9_000).collect()
    assert len({r["sequence_id"] >> 32 for r in got}) >= 6
    windows = defaultdict(list)
    for r in got:
        windows[r["sequence_id"]].append(r["doc_id"] % 12)
    of_seed = sum(max(map(w.count, set(w))) for w in windows.values()) / sum(map(len, windows.values()))
    assert of_seed > 0.8
    assert {r["doc_id"] for r in got} == set(range(1200))


def test_neighbours_are_nearly_those_of_one_index(spark, sf_dir):
    """What windows take from an index in ten shards by content scores at least 0.95 of what one index over all documents gives them."""
    import duckdb
    import numpy as np
    import public_tokenizers

    rows = duckdb.sql(f"select doc_id, coalesce(text, '') from '{sf_dir.replace('0.001', '0.01')}/documents.parquet' order by doc_id").fetchall()
    e = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    docs = [np.append(e.encode(x), 0).astype("<u2") for _, x in rows]
    df = np.zeros(e.size)
    for x in docs:
        df[np.unique(x[:-1])] += 1
    idf, sizes = np.log(1 + (len(docs) - df + 0.5) / (df + 0.5)), np.array([len(x) for x in docs])
    mean = sizes.mean()
    borders = packing.Borders(np.array([packing.projected(x, idf) for x in docs], np.float16), sizes, 10)
    rnd = np.random.default_rng(3)

    def taken(place) -> float:
        got = []
        for k in np.unique(place):
            mine = [docs[i] for i in np.nonzero(place == k)[0]]
            index = packing.Index(mine, idf, mean)
            score, seed, first = None, None, 0
            for doc, start, length, sequence, offset in packing.fill(mine, index):
                if start == 0:
                    if seed is not None and doc != seed:
                        got.append(score[doc] / np.sqrt(len(mine[doc])))
                    first = sequence
                if start + length == len(mine[doc]) and (seed is None or sequence != first or offset + length == packing.WINDOW):
                    seed, score = doc, index.scores(doc)
        return float(np.mean(got))

    whole = taken(np.zeros(len(docs), int))
    content = taken(np.array([borders.shard(packing.projected(x, idf), rnd.random()) for x in docs]))
    dealt = taken(rnd.integers(0, 10, len(docs)))
    print(whole, content, dealt)
    assert content > 0.95 * whole and content > dealt
