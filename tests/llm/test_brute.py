"""Each operator against a plain version on the small tables."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factloom.llm import audio, bpe, feistel, langid, line_dedup, lm, packing, quality, scaled_sketch, simhash
from factloom.llm.queries import oracle_sql, queries
from tests.oracle import both, connection


@pytest.fixture(scope="module")
def docs(sf_dir):
    con = connection(sf_dir)
    return dict(con.sql("select doc_id, coalesce(text, '') from documents").fetchall())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(name, spark, sf_dir):
    got, expected = both(queries()[name](spark, sf_dir), connection(sf_dir), oracle_sql()[name])
    assert got == expected


def test_packing(spark, sf_dir, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = queries()["op1_retrieval_packing"](spark, sf_dir).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in docs.items():
        ids, at = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(len(w) > 0 for w in windows.values()) * 1024 - sum(r["length"] for r in rows) <= 1024 * (1 + sum(r["length"] for r in rows) // packing.SHARD_TOKENS)


def test_packing_takes_neighbours(spark):
    """Three topics of short documents: a window's documents are of one topic but where it runs out."""
    topics = ["alpha beta gamma delta", "ein zwei drei vier", "rouge vert bleu noir"]
    rows = [(i, " ".join(topics[i % 3].split()[(i + j) % 4] for j in range(40))) for i in range(60)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), window=256).collect()
    windows = defaultdict(set)
    for r in got:
        windows[r["sequence_id"]].add(r["doc_id"] % 3)
    assert sum(map(len, windows.values())) <= len(windows) + 4


def test_encoder_matches_library():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    e, t, rnd = packing.Encoder(path), Tokenizer.from_file(path), random.Random(3)
    alphabet = "aàb  \t\n\r\x85\xa0　\x1c'sé漢🙂12-.‍\x00zZ"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 50))) for _ in range(2000)] + ["a<|endoftext|>b", "", " " * 300, "a" * 3000]
    assert e.merger is not None
    assert all(e.encode(x).tolist() == t.encode(x, add_special_tokens=False).ids for x in texts)


def test_audio_round_trip(spark, sf_dir, docs):
    for r in queries()["op2_audio_features"](spark, sf_dir).collect():
        raw = docs[r["doc_id"]].encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        wav = b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 16000, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(payload), len(wav))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["media_sha256"] == hashlib.sha256(wav).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])


def test_audio_parts():
    x = np.sin(2 * np.pi * 440 * np.arange(16000) / 16000).astype(np.float32)
    y = audio.resample(x, 16000, 8000)
    want = np.sin(2 * np.pi * 440 * np.arange(8000) / 8000)
    assert np.abs(y[100:-100] - want[100:-100]).max() < 0.02
    z = audio.resample(x, 16000, 24000)
    assert len(z) == 24000 and np.abs(z[200:-200] - np.sin(2 * np.pi * 440 * np.arange(24000) / 24000)[200:-200]).max() < 0.05
    quiet = np.concatenate((np.zeros(8000, np.float32), y, np.zeros(8000, np.float32)))
    mel, energy = audio.log_mel(quiet, 8000)
    found = audio.segments(energy)
    assert len(found) == 1 and abs(found[0][0] - 80) <= 3 and abs(found[0][1] - 160) <= 3
    table = audio.read_tensors(audio.tensors(mel, 8000))
    t = table.column("tensor").combine_chunks().to_numpy_ndarray()
    assert t.shape[1:] == (audio.FRAMES, audio.MELS) and np.array_equal(t.reshape(-1, audio.MELS)[: len(mel)], mel.astype(np.float16))
    assert sum(table.column("frames").to_pylist()) == len(mel) and table.column("start_s")[0].as_py() == 0


def _plain_features(raw: bytes):
    """Mel bands, energies and segments of a payload by the definitions, in loops and double precision."""
    rate, target = audio.RATE, audio.TARGET
    x = [(b - 128) / 128 for b in raw]
    down, wide = rate // target, 8 * (rate // target)
    taps = [math.sin(math.pi * t / down) / (math.pi * t / down) * (0.5 + 0.5 * math.cos(math.pi * t / (wide + 1))) if t else 1.0 for t in range(-wide, wide + 1)]
    total = sum(taps)
    y = [sum(taps[j] / total * x[n * down + wide - j] for j in range(len(taps)) if 0 <= n * down + wide - j < len(x)) for n in range(-(-len(x) // down))]
    hz = lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = [hz(i * 2595 * math.log10(1 + target / 2 / 700) / (audio.MELS + 1)) for i in range(audio.MELS + 2)]
    mel, energy = [], []
    for k in range(max(1, -(-max(0, len(y) - audio.FRAME) // audio.HOP) + 1)):
        frame = [(y[k * audio.HOP + i] if k * audio.HOP + i < len(y) else 0.0) * (0.5 - 0.5 * math.cos(2 * math.pi * i / (audio.FRAME - 1))) for i in range(audio.FRAME)]
        energy.append(10 * math.log10(sum(v * v for v in frame) / audio.FRAME + 1e-6))
        power = [abs(sum(v * complex(math.cos(2 * math.pi * f * i / audio.POINTS), -math.sin(2 * math.pi * f * i / audio.POINTS)) for i, v in enumerate(frame))) ** 2 for f in range(audio.POINTS // 2 + 1)]
        mel.append([math.log10(1e-6 + sum(w * max(0.0, min((f * target / audio.POINTS - edges[b]) / (edges[b + 1] - edges[b]), (edges[b + 2] - f * target / audio.POINTS) / (edges[b + 2] - edges[b + 1]))) for f, w in enumerate(power))) for b in range(audio.MELS)])
    base, found, start, loud = float(np.median(energy)), [], None, False
    for k, v in enumerate([*energy, -1e9]):
        if v > base + audio.LOW:
            start, loud = (k if start is None else start), loud or v > base + audio.HIGH
        elif start is not None:
            found += [(start, k)] if loud else []
            start, loud = None, False
    return np.array(mel), np.array(energy), found


def test_audio_features_by_definition(spark):
    """Resampling, filterbanks, segments and the stored tensors of a few texts against plain loops."""
    rnd = np.random.default_rng(4)
    texts = ["", "a short line", "x" * 700, "".join(chr(int(c)) for c in rnd.integers(32, 127, 900)) + " " * 900 + "~!" * 400]
    table, loud = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 0
    for r in audio.stored_features(table).collect():
        raw = texts[r["doc_id"]].encode()
        mel, energy, found = _plain_features(raw + b"\0" * (r["payload_bytes"] - len(raw)))
        stored = audio.read_tensors(bytes(r["tensors"])).column("tensor").combine_chunks().to_numpy_ndarray().reshape(-1, audio.MELS)
        assert r["n_frames"] == len(mel) and np.abs(stored[: len(mel)] - mel).max() < 0.01
        assert [(round(s["start_s"] * audio.TARGET / audio.HOP), round(((s["end_s"] * audio.TARGET) - audio.FRAME) / audio.HOP + 1)) for s in r["segments"]] == found
        means = [int(v) for v in r["feature"].split(" ")[-1].split(",")]
        assert np.abs(np.array(means) - mel.mean(axis=0) * 100).max() < 1
        loud += len(found)
    assert loud


def _model(texts, learned):
    """Counts and probabilities by the definition: pairs that make up one in PAIRS tokens are contexts as well."""
    seen, follow, starts = Counter(), defaultdict(Counter), 0
    toks = {i: [b" start", *re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), x.encode())), b" end"] for i, x in texts.items()}
    for i in texts:
        if learned(i):
            w = toks[i]
            starts += 1
            seen.update(w[1:])
            for k in range(1, len(w)):
                follow[w[k - 1],][w[k]] += 1
                if k > 1:
                    follow[w[k - 2], w[k - 1]][w[k]] += 1
    n, v = sum(seen.values()), len(seen)
    kept = {h for h, f in follow.items() if len(h) == 1 or sum(f.values()) * 20_000 >= n + starts}
    assert any(len(h) == 2 for h in kept) and any(len(h) == 2 for h in follow.keys() - kept)
    root = lambda w: (seen[w] + 0.1) / (n + 0.1 * (v + 1))

    def p(h, w):
        if not h:
            return root(w)
        if h not in kept:
            return p(h[1:], w)
        f = follow[h]
        return (f[w] + len(f) * p(h[1:], w)) / (sum(f.values()) + len(f))

    out = {}
    for i, w in toks.items():
        base = sum(math.log10(root(x)) for x in w[1:])
        score = sum(math.log10(p(tuple(w[max(0, k - 2) : k]), w[k])) for k in range(1, len(w)))
        out[i] = (len(w) - 1, sum(seen[x] > 0 for x in w[1:]), n, base, score)
    return out


@pytest.mark.parametrize("batch_bytes", [8 << 20, 20_000])
def test_automaton(batch_bytes, spark, sf_dir, docs):
    """Also with many shards, where frequent words are spread over several, and blocks that do not see all pairs."""
    learned = lambda i: zlib.crc32(str(i).encode()) % 10 != 0
    want = _model(docs, learned)
    table = spark.createDataFrame([(i, x, learned(i)) for i, x in docs.items()], "doc_id long, text string, learned boolean")
    got = lm.scored(table, batch_bytes, 20_000, 4_000).collect()
    assert len(got) == len(docs)
    for r in got:
        n, known, total, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)


def test_automaton_beats_base(spark, sf_dir):
    held = queries()["op3_backoff_automaton"](spark, sf_dir).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_scaled_sketch(spark, sf_dir, docs):
    ids = sorted(docs, reverse=True)
    shingles = lambda x: {tuple(w[j : j + 5]) for w in [x.lower().split()] for j in range(max(1, len(w) - 4))} if x.split() else set()
    got = {r["doc_id"]: r for r in queries()["op4_scaled_sketch"](spark, sf_dir).collect()}
    error = []
    for k, i in enumerate(ids):
        x, y = docs[i], docs[ids[(k + 1) % len(ids)]]
        edit = x[: len(x) - len(x) // 2] + y[: len(x) // 2]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(x), hashlib.sha256(edit.encode()).hexdigest())
        a, b = shingles(x), shingles(edit)
        error.append(abs(r["near_edited"] - (len(a & b) / min(len(a), len(b)) if a and b else float(a == b))))
        if docs[ids[(k + 1) % len(ids)]] == x:
            assert r["near_next"] == 1.0
    assert np.mean(error) < 0.1


def test_sketches_merge(spark):
    """The sketch of a joint text is the union of the sketches of its parts, but for the shingles over the seam; for short parts as for long ones."""
    for n in (30, 3000):
        a, b = " ".join(f"w{i}" for i in range(n)), " ".join(f"v{i}" for i in range(n))
        df = spark.createDataFrame([(a, b)], "a string, b string")
        r = df.select(scaled_sketch.sketch(F.col("a")).alias("a"), scaled_sketch.sketch(F.col("b")).alias("b"), scaled_sketch.sketch(F.concat_ws(" ", "a", "b")).alias("ab"))
        r = r.select(F.size(F.array_except("ab", F.array_union("a", "b"))).alias("extra"), F.size(F.array_except(F.array_union("a", "b"), "ab")).alias("lost"), scaled_sketch.containment(F.col("a"), F.col("ab")).alias("c"), F.size("a").alias("n")).first()
        assert r["extra"] <= 4 and r["lost"] == 0 and r["c"] == 1.0 and abs(r["n"] - n / scaled_sketch.SCALE) < 0.3 * n
        top = scaled_sketch._threshold(scaled_sketch.SCALE)
        assert all(x < top for x in df.select(scaled_sketch.sketch(F.col("a"))).first()[0])


def test_next_over_many_ranges(spark):
    """With many small ranges, ties and nulls: a ring in descending order."""
    ids = [None, None, 5, 5, 5, *range(7, 300, 3)]
    rows = [(i, f"text {k}") for k, i in enumerate(ids)]
    got = scaled_sketch.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), rows_a_range=4).collect()
    after = {r["text"]: r["next_text"] for r in got}
    at, ring = f"text {len(ids) - 1}", []
    for _ in rows:
        ring.append(at)
        at = after[at]
    assert at == f"text {len(ids) - 1}" and len(set(ring)) == len(rows)
    order = [ids[int(x.split()[1])] for x in ring]
    assert order == sorted([i for i in ids if i is not None], reverse=True) + [None, None]


def _fingerprint(x):
    w = re.findall(rb"[^\x20\x09-\x0D]+", x.encode().lower())
    s = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(v, 42) for v in s]
    return sum(1 << i for i in range(64) if 2 * sum(v >> i & 1 for v in h) > len(h))


def _components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(spark, sf_dir, docs):
    prints = {i: _fingerprint(x) for i, x in docs.items()}
    want = _components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries()["op5_simhash_near_dedup"](spark, sf_dir).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in docs}


def test_crowded_blocks(spark, monkeypatch):
    """With a low bound most links come from shared variants; none is lost and none made up."""
    monkeypatch.setattr(simhash, "PAIRWISE", 3)
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 4)
    values = {int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for c in centres for _ in range(30)}
    prints = {i: v for i, v in enumerate(sorted(values))}
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in prints.values()], "fp long")
    found = simhash.components(simhash.links(df)).collect()
    name = {v - (1 << 64) if v >> 63 else v: i for i, v in prints.items()}
    groups = defaultdict(set)
    for r in found:
        groups[r["root"]].add(name[r["node"]])
    want = defaultdict(set)
    for i, c in _components(prints).items():
        want[c].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_language(spark, sf_dir):
    con = connection(sf_dir)
    lang = dict(con.sql("select doc_id, lang from documents").fetchall())
    got = [r for r in queries()["op6_language_id"](spark, sf_dir).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in got) / len(got) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_rejects_the_unknown():
    model = langid.fit([("the cat and the dog went out", "en"), ("der hund und die katze", "de")] * 50)
    assert model.predict(None) == ("und", 0.0) and model.predict("123 !!") == ("und", 0.0)
    assert model.predict("the dog and the cat")[0] == "en" and model.predict("die katze und der hund")[0] == "de"
    assert model.predict("漢字漢字 кириллица")[1] < model.predict("the dog and the cat")[1]


def test_language_rejection_is_calibrated(spark, sf_dir):
    """Of texts with letters, those in no learned language are mostly rejected and those in one hardly ever."""
    import random

    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    model = langid.train(docs.where("doc_id % 2 = 0"))
    rnd = random.Random(9)
    own = [r["text"] for r in docs.where("doc_id % 2 = 1 and n_chars > 200").collect()]
    strange = [" ".join("".join(rnd.choice(abc) for _ in range(rnd.randint(2, 9))) for _ in range(40)) for abc in ("абвгдежзиклмнопрст", "αβγδεζηθικλμνξοπρ", "qxzjkwvy", "あいうえおかきくけこ") for _ in range(10)]
    rejected = lambda xs: sum(model.predict(x)[1] < model.threshold for x in xs) / len(xs)
    print(rejected(own), [rejected(strange[i : i + 10]) for i in (0, 10, 20, 30)])
    assert rejected(own) < 0.01 and rejected(strange) > 0.5


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_feistel(n, spark):
    df = spark.range(n).select(feistel.permuted(F.col("id"), F.lit(n).cast("long")).alias("p"))
    assert sorted(r["p"] for r in df.collect()) == list(range(n))


def test_shards(spark, sf_dir, docs):
    got = queries()["op7_feistel_shards"](spark, sf_dir).collect()
    slots = defaultdict(list)
    for r in got:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    for parts in ("4", "64"):
        other = spark.newSession()
        other.conf.set("spark.sql.shuffle.partitions", parts)
        again = queries()["op7_feistel_shards"](other, sf_dir).select("doc_id", "shard", "slot").collect()
        assert {(r["doc_id"], r["shard"], r["slot"]) for r in got} == {tuple(r) for r in again}


def test_lines(spark):
    rows = [(i, f"own line {i}\nshared by many\nby few" if i < 3 else f"own line {i}\nshared by many\nshared by many", f"s{i % 12}") for i in range(30)]
    out = {r["doc_id"]: r["text"] for r in line_dedup.without_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[0] == "own line 0\nshared by many\nby few" and out[1] == "own line 1\nby few" and out[5] == "own line 5"


def _kneser_ney(texts, tokens):
    """Log10 probability of each of the tokens by the formulas, from counts of the texts."""
    pairs = Counter(p for x in texts for w in [["<s>", *x.split(), "</s>"]] for p in zip(w, w[1:], strict=False))

    def discounts(counts):
        n = Counter(counts)
        if not n[1] or not n[2]:
            return lambda c: (0.5, 0.75, 0.9)[min(c, 3) - 1]
        y = n[1] / (n[1] + 2 * n[2])
        d = (1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 0.9)
        return lambda c: min(max(d[min(c, 3) - 1], 0.05), min(c, 3) - 0.05)

    high, k = discounts(pairs.values()), Counter(w for _, w in pairs)
    low = discounts(k.values())
    spared = sum(low(c) for c in k.values()) / len(pairs) / (len(k) + 1)

    def p(u, w):
        lower = (max(k[w] - low(k[w]), 0) / len(pairs) if k[w] else 0) + spared
        after = {b: c for (a, b), c in pairs.items() if a == u}
        if not after:
            return lower
        total = sum(after.values())
        return (after[w] - high(after[w]) if w in after else 0) / total + sum(high(c) for c in after.values()) / total * lower

    w = ["<s>", *tokens.split(), "</s>"]
    return [math.log10(p(a, b)) for a, b in zip(w, w[1:], strict=False)]


def test_kneser_ney(spark):
    """The model's probabilities against the formulas on counts by hand, and its distributions sum to one."""
    import random

    rnd = random.Random(2)
    texts = [" ".join(rnd.choices("abcdefgh", weights=(40, 20, 10, 8, 4, 2, 1, 1), k=rnd.randint(1, 25))) for _ in range(60)]
    docs = spark.createDataFrame(list(zip(range(60), texts, ["en"] * 60, strict=True)), "doc_id long, text string, lang string")
    judged = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    held = {r["doc_id"] for r in docs.where(F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(quality.HELD)) == 0).collect()}
    m = quality.train(docs, judged)
    fit = [x for i, x in enumerate(texts) if i not in held]
    assert 5 < len(held) < 40
    for x in (*texts, "a b zz c", "zz zz", ""):
        assert m.tokens(x) == pytest.approx(_kneser_ney(fit, x), rel=1e-5)
    n = len(m.low)
    dense = np.outer(m.back, m.low)
    dense[m.keys // n, m.keys % n] += m.share
    seen = [m.words[w] for w in (b"a", b"b", b"c")] + [m.start]
    dense[:, m.start] = 0  # never read
    assert np.allclose(dense[seen].sum(axis=1), 1, atol=1e-5)


def test_quality_keeps_the_trusted(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.01")
    got = queries()["op9_kneser_ney_quality"](spark, sf_dir)
    rows = got.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("quality = 0 or toxic = 0").groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in rows}
    print(kept)
    assert kept[1] > 0.98 and kept[0] < 0.35


def test_bpe_is_tiktoken(spark, sf_dir, docs):
    import random

    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in queries()["op10_byte_bpe"](spark, sf_dir).collect():
        ids = t.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
    c, rnd = bpe.codec(path, public_tokenizers.PATTERN), random.Random(5)
    alphabet = "aàb  \t\n\r\x85\xa0　\x1c'sé漢🙂12-.‍\x00zZ"
    for _ in range(2000):
        x = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60)))
        assert c.encode(x) == t.encode_ordinary(x) and c.decode(c.encode(x)) == x.encode()
    assert c.encode("ab" * 4000) == t.encode_ordinary("ab" * 4000)
