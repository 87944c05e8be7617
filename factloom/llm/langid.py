"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

One class more than there are languages stands for none of them. It learns from noise made out of the training texts, so that texts in other languages and scripts
have somewhere to go, and the calibrated probability of the best language says whether to reject.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import documents, give_back, id_crc, small_batches, written

BUCKETS, DIM = 1 << 16, 16
SUBWORDS = (1, 2, 3, 4)
#: Documents of a group, in the mean; each group trains by itself from the same start, and the model is the mean of all.
GROUP = 4_000
#: One labelled document in HELD, of languages with as many at least, sets temperature and threshold instead of training.
HELD = 5
#: Buckets of a piece of a model, and groups that are added up at a time.
PIECE, ADDED = 1 << 12, 64
TEMPERATURES = np.geomspace(0.05, 5, 60)
EPOCHS, RATE = 6, 0.4
#: A group of few documents reads them more often, until it has made so many steps.
STEPS = 4_000
#: Share of the calibration fold's right answers that rejection may cost; and the probability above which none is rejected:
#: there an answer is more likely right than wrong.
LOST, SURE = 0.002, 0.5
UNKNOWN = "und"

#: Bytes that are letters stay; all else separates words. Bytes from 0x80 on are parts of letters or of other marks of UTF-8.
_LETTERS = bytes(i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def letters(text: str) -> np.ndarray:
    """The bytes of the lower-cased words of text, a space between them and at both ends."""
    words = text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()
    return np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)


def buckets(b: np.ndarray) -> np.ndarray:
    """Hash buckets of the byte n-grams of letters(), word edges included."""
    b = b.astype(np.uint32)
    out = []
    for n in SUBWORDS:
        if len(b) < n:
            break
        h = np.full(len(b) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for j in range(n):
            h ^= b[j : len(b) - n + 1 + j]
            h *= np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        out.append(h & np.uint32(BUCKETS - 1))
    return np.concatenate(out)


def subwords(text: str) -> np.ndarray:
    return buckets(letters(text))


def noise_like(b: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Words of the same lengths in no language: the alphabet permuted, letters drawn at random, or letters of some other script, of two or three bytes."""
    kind, out = int(rng.integers(4)), b.copy()
    at = np.nonzero(b != 32)[0]
    if kind == 0:
        table = np.arange(256, dtype=np.uint8)
        table[97:123] = 97 + rng.permutation(26)
        return table[out]
    if kind == 1:
        out[at] = rng.choice(np.arange(97, 123), len(at), p=rng.dirichlet(np.full(26, 0.5)))
        return out
    n = kind
    block = int(rng.integers(0xC4, 0xE0)) if n == 2 else int(rng.integers(0xE0, 0xF0))
    wide = np.repeat(out, np.where(out == 32, 1, n))
    place = np.nonzero(wide != 32)[0]
    wide[place] = rng.integers(0x80, 0xC0, len(place))
    wide[place[::n]] = block + rng.integers(0, 2, len(place[::n]))
    if n == 3:
        wide[place[1::3]] = 0x80 + int(rng.integers(0, 60)) + rng.integers(0, 4, len(place[1::3]))
    return wide


def _shares(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different buckets of letters(), which 16 bits number, and each one's share of them."""
    at, count = np.unique(buckets(b), return_counts=True)
    return at.astype(np.uint16), (count / count.sum()).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


@dataclass
class Model:
    """logits: a text's scores are the mean of its subwords' rows, the last for none of the languages; noise: the share of answers expected to be wrong at best;
    below threshold an answer is rejected."""

    langs: list[str]
    logits: np.ndarray
    temperature: float
    threshold: float
    noise: float = 0.0

    def __post_init__(self):
        #: logits by class, each column's in one piece
        self.columns = list(np.ascontiguousarray(self.logits.T))

    def scores(self, text: str) -> np.ndarray:
        at = subwords(text)
        total = np.zeros(self.logits.shape[1], np.float64)
        for i in range(0, len(at), 1 << 18):
            part = at[i : i + (1 << 18)].astype(np.intp)
            total += [column.take(part).sum(dtype=np.float64) for column in self.columns]
        z = total / len(at) / self.temperature
        p = np.exp(z - z.max())
        return (1 - self.noise) * p / p.sum() + self.noise / len(p)

    def predict(self, text: str | None) -> tuple[str, float]:
        """A learned language and its calibrated probability; UNKNOWN and 0 for null and for texts without a letter."""
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        p = self.scores(text)
        k = int(p[:-1].argmax())
        return self.langs[k], float(p[k])


def _sgd(train: list, classes: int, rng: np.random.Generator, epochs: int) -> np.ndarray:
    """Logits of all buckets, from (shares, class) pairs."""
    e = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    w = np.zeros((DIM, classes), np.float32)
    steps, step = epochs * len(train), 0
    for _ in range(epochs):
        for i in rng.permutation(len(train)):
            (at, share), y = train[i]
            at = at.astype(np.intp)
            # the rows are read once; buckets of a text differ, so they can be written back whole
            rows = e.take(at, 0)
            h = share @ rows
            z = h @ w
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            lr = np.float32(RATE * (1 - step / steps))
            back = w @ p
            w -= lr * np.outer(h, p)
            rows -= np.multiply.outer((lr * len(at)) ** np.float32(0.5) * share, back)
            e[at] = rows
            step += 1
    return (e @ w).astype(np.float32)


def fit(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """A model from (text, lang) pairs and noise made of them, as much as of a language: four fifths train it by SGD, the rest set temperature and threshold."""
    langs = sorted({y for _, y in rows})
    rng = np.random.default_rng(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    none, number = len(langs), {y: k for k, y in enumerate(langs)}
    kept = [(letters(x), number[y]) for x, y in rows if has_letter(x)]
    if not kept:
        return Model([], np.zeros((BUCKETS, 0), np.float32), 1.0, 0.0)
    every = max(1, len(langs))
    seen = [(b, y) for i, (b, k) in enumerate(kept) for b, y in ((b, k), *([(noise_like(b, rng), none)] if i % every == 0 else ()))]
    data = [(_shares(b), y) for b, y in seen]
    del kept, seen
    cut = max(1, len(data) * 4 // 5)
    train, held = data[:cut], data[cut:] or data
    logits = _sgd(train, len(langs) + 1, rng, EPOCHS)
    z = np.array([share.astype(np.float64) @ logits[at].astype(np.float64) for (at, share), _ in held])
    y = np.array([k for _, k in held])

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    temperature = min(TEMPERATURES, key=loss)
    s = z / temperature
    p = np.exp(s - s.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    noise = (int((p.argmax(axis=1) != y).sum()) + 1) / (len(y) + 2)
    p = (1 - noise) * p + noise / p.shape[1]
    right = p.max(axis=1)[(p.argmax(axis=1) == y) & (y != none)]
    threshold = min(float(np.quantile(right, LOST)) if len(right) else 0.0, SURE)
    return Model(langs, logits, float(temperature), threshold, noise)


_PART = T.StructType([T.StructField("piece", T.LongType()), T.StructField("part", T.LongType()), T.StructField("n", T.LongType()), T.StructField("logits", T.BinaryType())])


def _group_model(langs: list[str]):
    """Trains one group's documents, and noise made of them as much as of a language, and gives its logits in pieces."""
    number = {y: k for k, y in enumerate(langs)}

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        # the order is that of the group's rows by content
        pdf = pdf.sort_values(["lot", "text", "lang"], kind="stable")
        group = int(pdf["group"].iloc[0])
        rng = np.random.default_rng([7, group])
        kept = [(letters(x), number[y]) for x, y in zip(pdf["text"], pdf["lang"], strict=True) if has_letter(x)]
        if not kept:
            return pd.DataFrame({f.name: [] for f in _PART})
        data = [(_shares(b), y) for i, (c, k) in enumerate(kept) for b, y in ((c, k), *([(noise_like(c, rng), len(langs))] if i % len(langs) == 0 else ()))]
        # all groups start alike, so that their means are means of like things
        logits = _sgd(data, len(langs) + 1, np.random.default_rng(7), max(EPOCHS, -(-STEPS // len(data))))
        return pd.DataFrame({"piece": np.arange(BUCKETS // PIECE), "part": group, "n": 1, "logits": [logits[i : i + PIECE].tobytes() for i in range(0, BUCKETS, PIECE)]})

    return fitted


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.float32 if n == 1 else np.float64).astype(np.float64) for n, x in zip(pdf.sort_values("part")["n"], pdf.sort_values("part")["logits"], strict=True))
    return pd.DataFrame({"piece": [pdf["piece"].iloc[0]], "part": [pdf["part"].iloc[0] // ADDED], "n": [pdf["n"].sum()], "logits": [np.asarray(total, np.float32 if pdf["n"].sum() == 1 else np.float64).tobytes()]})


_SEEN = T.StructType([T.StructField("y", T.LongType()), T.StructField("z", T.ArrayType(T.DoubleType()))])


def _logits(shared, langs: list[str]):
    number = {y: k for k, y in enumerate(langs)}

    def seen(batches):
        model = shared.value
        for pdf in batches:
            rows = []
            for x, lang, lot in zip(pdf["text"], pdf["lang"], pdf["lot"], strict=True):
                if has_letter(x):
                    b = letters(x)
                    texts = [(b, number[lang]), *([(noise_like(b, np.random.default_rng(lot & (1 << 63) - 1)), len(langs))] if lot // HELD % len(langs) == 0 else [])]
                    for c, y in texts:
                        at, share = _shares(c)
                        rows.append((y, (share.astype(np.float64) @ model[at].astype(np.float64)).tolist()))
            yield pd.DataFrame(rows, columns=["y", "z"])

    return seen


def _losses(batches):
    """The summed loss at each of TEMPERATURES."""
    for pdf in batches:
        if len(pdf):
            z, y = np.stack(pdf["z"].to_numpy()), pdf["y"].to_numpy()
            for k, t in enumerate(TEMPERATURES):
                s = z / t
                s = s - s.max(axis=1, keepdims=True)
                yield pd.DataFrame({"k": [k], "loss": [float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).sum())]})


def train(labelled: DataFrame, group: int = GROUP) -> Model:
    """A model from all rows of (doc_id, text, lang) that have both, whole texts: groups of about as many documents as told train side by side by SGD, and the model is their mean.

    A language that is rare has its documents in several groups, so that half an equal share of each is its own where it has so many. One in HELD documents is kept
    from training; temperature and threshold come from all of these, by aggregation. What is collected is the model and a row for each language.

    Repeated rows count as often; empty texts and those without a letter teach nothing; an empty table, or one without languages, gives a model that answers UNKNOWN.
    Other columns are not read.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang", F.xxhash64("doc_id", "text").alias("lot"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return fit([])
    spark = labelled.sparkSession
    several = [k for k in langs if counts[k] >= HELD]
    held = (F.pmod("lot", F.lit(HELD)) == 0) & F.col("lang").isin(several)
    groups = -(-sum(counts.values()) // group)
    copies = F.create_map(*[F.lit(v) for k in langs for v in (k, min(groups, max(1, -(-groups * group // (2 * len(langs) * counts[k])))))])
    times = F.element_at(copies, F.col("lang"))
    base = F.pmod(F.xxhash64("lot", F.lit("group")), F.lit(groups))
    places = F.transform(F.sequence(F.lit(0), times - 1), lambda j: F.pmod(base + F.floor(j * groups / times), F.lit(groups)))
    parts = rows.where(~held).withColumn("group", F.explode(places)).groupBy("group").applyInPandas(_group_model(langs), _PART)
    parts = written(parts, "parts")
    n = parts.where("piece = 0").count()
    if not n:
        return fit([])
    total, left = parts, groups
    while True:
        total, left = total.groupBy("piece", F.floor(F.col("part") / ADDED)).applyInPandas(_added, _PART), -(-left // ADDED)
        if left <= 1:
            break
    pieces = {r["piece"]: np.frombuffer(r["logits"], np.float32 if r["n"] == 1 else np.float64) for r in total.collect()}
    logits = (np.concatenate([pieces[k] for k in sorted(pieces)]) / n).astype(np.float32).reshape(BUCKETS, len(langs) + 1)
    shared = spark.sparkContext.broadcast(logits)
    judge = lambda of: written(of.mapInPandas(_logits(shared, langs), _SEEN), "seen")
    seen = judge(rows.where(held))
    if seen.isEmpty():
        seen = judge(rows)
    loss = {r["k"]: r["loss"] for r in seen.mapInPandas(_losses, "k long, loss double").groupBy("k").agg(F.sum("loss").alias("loss")).collect()}
    temperature = float(TEMPERATURES[min(sorted(loss), key=loss.get)])
    top = F.array_max("z")
    best = F.array_position("z", top) - 1
    p = 1 / F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp((x - top) / temperature))
    told = seen.select("y", best.alias("best"), p.alias("p"))
    wrong = told.agg(F.count("*").alias("n"), F.sum((F.col("best") != F.col("y")).cast("long")).alias("wrong")).first()
    noise = (wrong["wrong"] + 1) / (wrong["n"] + 2)
    low = told.where((F.col("best") == F.col("y")) & (F.col("y") < len(langs))).agg(F.percentile("p", F.lit(LOST))).first()[0]
    threshold = 0.0 if low is None else min((1 - noise) * low + noise / (len(langs) + 1), SURE)
    give_back()
    return Model(langs, logits, temperature, threshold, noise)


def identified(docs: DataFrame, model: Model, to: str = "lang_id") -> DataFrame:
    """docs and a struct (lang_pred, score, rejected) for the whole column text, in a column named to, which replaces one of that name: rejected where there
    is nothing to judge or the calibrated probability is below the model's threshold.

    Null and empty texts and those without a letter are UNKNOWN with a score of 0; very long texts are judged whole; of languages that tie the first by name
    is given; repeated rows get the same answer; an empty table gives no rows. Only text is read; other columns pass through.
    """
    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(schema)
    def answers(text: pd.Series) -> pd.DataFrame:
        m = shared.value
        got = [m.predict(x) for x in text]
        return pd.DataFrame([(k, p, k == UNKNOWN or p < m.threshold) for k, p in got], columns=["lang_pred", "score", "rejected"])

    return docs.withColumn(to, answers(F.col("text")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fold = id_crc(F.col("doc_id")) % 3
    model = train(docs.where(fold != 1).select("doc_id", "text", "lang"))
    out = identified(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (id_crc(F.col("doc_id")) % 3 == 1).alias("held_out"), "lang_id.lang_pred", "lang_id.score", F.col("lang_id.rejected").alias("rejected"))
