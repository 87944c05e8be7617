"""Quality by perplexity: an interpolated modified Kneser-Ney bigram model of trusted text, thresholds by language.

All trusted documents teach the model or set thresholds, whole. Counts are summed in shards and sent to the batches of documents that ask (kneser_ney), so no machine holds the model.
train() gives the same model in one piece, for corpora small enough for that, and tests hold the batches against it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import kneser_ney
from factloom.llm.common import SPACE, documents, free, give_back, labels, meanwhile, small_batches, written
from factloom.llm.feistel import numbered

#: One trusted document in HELD sets thresholds instead of training.
HELD = 3
#: A language's threshold is this quantile of its held-out trusted documents' excess, and NORMAL is that of the normal distribution.
QUANTILE, NORMAL = 0.995, 2.576
#: What a language's held-out documents say counts as they are many, and what all languages' say as PRIOR documents would; all languages' quantile is drawn
#: to the normal one by the same weights. So the rule is one for samples of every size.
PRIOR = 50
_START, _END = "\x02 start", "\x02 end"


def _share(sizes: dict[int, int], sample: int) -> int:
    """The largest number of documents, 1 at least, that each language (sizes: documents to languages of that many) can give to a sample."""
    left, langs = sample, sum(sizes.values())
    for n in sorted(sizes):
        if n * langs > left:
            return max(1, left // langs)
        left, langs = left - n * sizes[n], langs - sizes[n]
    return max(sizes, default=1)


def _good(judged: DataFrame) -> DataFrame:
    """The ids that are labelled quality 1 and not toxic."""
    return judged.groupBy("doc_id").agg(F.min("quality").alias("__quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("__toxic")).where("__quality = 1 and __toxic = 0").select("doc_id")


def _held() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(HELD)) == 0


def trusted(docs: DataFrame, judged: DataFrame, sample: int | None = None) -> DataFrame:
    """All rows (doc_id, text, lang) that are labelled quality 1 and not toxic, or with sample at most so many.

    Each language has an equal share of a sample, drawn by a hash; what small ones leave goes to the others, so that no language is lost for being rare.
    """
    good = _good(judged).select(F.col("doc_id").alias("__of"))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text", lang.cast("string").alias("lang"))
    if sample is None:
        kept = F.min(F.struct("text", "lang")).alias("kept")
        return rows.join(good, F.col("doc_id") == F.col("__of"), "left_semi").groupBy("doc_id").agg(kept).select("doc_id", "kept.text", "kept.lang")
    # ids are drawn first, so that texts are not sorted
    ids = written(rows.select("doc_id", "lang").join(good, F.col("doc_id") == F.col("__of"), "left_semi").groupBy("doc_id").agg(F.min("lang").alias("lang")), "trusted_ids")
    # at most as many languages as documents are wanted, the largest first
    langs = ids.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()
    held: dict[int, int] = {}
    for r in langs:
        held[r["n"]] = held.get(r["n"], 0) + 1
    each = _share(held, sample)
    # a hash takes a few more of each language than its share, so that only those are ranked
    part = [(r["lang"], min(1.0, (each + 4 * each**0.5 + 4) / r["n"])) for r in langs]
    parts = docs.sparkSession.createDataFrame(part, "of string, part double")
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    some = ids.join(F.broadcast(parts), F.col("lang").eqNullSafe(F.col("of"))).where(lot < F.col("part"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    drawn = some.withColumn("place", place).where(F.col("place") <= each).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id")
    return rows.join(F.broadcast(drawn), "doc_id", "left_semi").dropDuplicates(["doc_id"])


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams seen once to four times."""
    n1, n2, n3, n4 = (float(x or 0) for x in n)
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.9]
    return tuple(min(max(x, 0.05), k - 0.05) for x, k in zip(d, (1, 2, 3), strict=True))


def _by_count(c: Column, values: tuple[float, float, float]) -> Column:
    return F.when(c == 1, values[0]).when(c == 2, values[1]).otherwise(values[2])


@dataclass
class Model:
    """words: numbers of words; low: log10 of the lower order by word, the last for unknown ones; back: log10 weight of a context's
    lower order; keys and share: bigrams (context * size + word) and their discounted share; by_lang: (mean, within, between, threshold)."""

    words: dict[bytes, int]
    low: np.ndarray
    back: np.ndarray
    keys: np.ndarray
    share: np.ndarray
    start: int
    end: int
    by_lang: dict

    def tokens(self, text: str | None) -> np.ndarray:
        """Log10 probability of each word of the whole text, and of its end."""
        n, get = len(self.low), self.words.get
        found = (text or "").encode("utf-8", "surrogatepass").split()
        seq = np.fromiter((self.start, *(get(w, n - 1) for w in found), self.end), np.int64, len(found) + 2)
        u, w = seq[:-1], seq[1:]
        key = u * n + w
        p = self.back[u] * self.low[w]
        if len(self.keys):
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            p = p + np.where(self.keys[at] == key, self.share[at], 0)
        return np.log10(p)

    def excess(self, lang: str | None, n: int, mean: float) -> tuple[float, float]:
        """How many deviations a mean surprise of n tokens lies above the language's, and the threshold."""
        middle, within, between, threshold = self.by_lang.get(lang) or self.by_lang[None]
        return (mean - middle) / np.sqrt(within / n + between), threshold


def _counts(fit: DataFrame) -> DataFrame:
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    seq = F.concat(F.array(F.lit(_START)), words, F.array(F.lit(_END)))
    both = F.arrays_zip(F.slice(seq, F.lit(1), F.size(seq) - 1).alias("u"), F.slice(seq, F.lit(2), F.size(seq) - 1).alias("w"))
    return fit.select(F.explode(both).alias("b")).groupBy("b.u", "b.w").agg(F.count("*").alias("c"))


def _of_count(c: str) -> list[Column]:
    return [F.sum(F.when(F.col(c) == k, 1).otherwise(0)) for k in (1, 2, 3, 4)]


def train(docs: DataFrame, judged: DataFrame, sample: int | None = None) -> Model:
    """The model in one piece, of all trusted rows, or of at most sample of them. It is collected, so this is for small corpora;
    keep_good and op9 use scored() instead. Without trusted rows the model rejects nothing."""
    rows = written(trusted(docs, judged, sample), "trusted")
    held = _held()
    pairs = written(_counts(rows.where(~held)), "bigrams")
    n = pairs.agg(*_of_count("c"), F.count("*")).first()
    if not n[4]:
        return Model({}, np.ones(1), np.ones(1), np.zeros(0, np.int64), np.zeros(0), 0, 0, {})
    d = _discounts(list(n[:4]))
    c = F.col("c")
    contexts = pairs.groupBy("u").agg(F.sum("c").alias("total"), F.sum(_by_count(c, d)).alias("spared"))
    continued = pairs.groupBy("w").agg(F.count("*").alias("k"))
    m = continued.agg(*_of_count("k"), F.count("*")).first()
    low_d = _discounts(list(m[:4]))
    spared = continued.agg(F.sum(_by_count(F.col("k"), low_d))).first()[0]
    every = F.lit(spared / n[4] / (m[4] + 1))
    vocabulary = contexts.select("u").unionByName(continued.select(F.col("w").alias("u"))).distinct().withColumnRenamed("u", "word")
    vocabulary = written(numbered(vocabulary, ["word"], "no", "size"), "words")
    low = vocabulary.join(continued, vocabulary["word"] == continued["w"], "left").join(contexts, vocabulary["word"] == contexts["u"], "left")
    low = low.select("word", "no", (F.coalesce((F.col("k") - _by_count(F.col("k"), low_d)) / n[4], F.lit(0.0)) + every).alias("low"), F.coalesce(F.col("spared") / F.col("total"), F.lit(1.0)).alias("back")).orderBy("no").toArrow()
    numbers = vocabulary.select("word", "no")
    shares = pairs.join(contexts, "u").join(numbers.select(F.col("word").alias("u"), F.col("no").alias("i")), "u").join(numbers.select(F.col("word").alias("w"), F.col("no").alias("j")), "w")
    size = low.num_rows + 1
    arcs = shares.select((F.col("i") * size + F.col("j")).alias("key"), ((c - _by_count(c, d)) / F.col("total")).cast("float").alias("share")).toArrow()
    keys = arcs.column("key").to_numpy()
    order = np.argsort(keys)
    words = {w.encode("utf-8", "surrogatepass"): i for i, w in enumerate(low.column("word").to_pylist())}
    model = Model(words, np.append(low.column("low").to_numpy(), spared / n[4] / (m[4] + 1)), np.append(low.column("back").to_numpy(), 1.0), keys[order], arcs.column("share").to_numpy()[order], words[_START.encode()], words[_END.encode()], {})
    seen = measured(rows.where(held), model, "__m").select("lang", "__m.n", "__m.mean", "__m.square").toArrow().to_pandas()
    if len(seen):
        model.by_lang = _thresholds(seen)
    del low, arcs, keys, order, seen
    give_back()
    return model


def _spread(g: pd.DataFrame) -> tuple[float, float, float]:
    """The middle of documents' mean surprise, its variance within documents by token, and between documents."""
    n, mean = g["n"].to_numpy(float), g["mean"].to_numpy(float)
    within = float(max((g["square"].to_numpy() * n).sum() / n.sum() - ((mean * n).sum() / n.sum()) ** 2, 1e-6))
    middle = float(np.median(mean[n >= np.median(n)]))
    return middle, within, float(max(np.median((mean - middle) ** 2 / 0.455 - within / n), 1e-4))


def _thresholds(seen: pd.DataFrame) -> dict:
    """(middle, within, between, threshold) of all documents (None) and of each language."""

    def told(g: pd.DataFrame, others: tuple[float, ...]) -> tuple[float, ...]:
        own = len(g) / (len(g) + PRIOR)
        middle, within, between = (own * x + (1 - own) * y for x, y in zip(_spread(g), others, strict=False))
        z = (g["mean"].to_numpy(float) - middle) / np.sqrt(within / g["n"].to_numpy(float) + between)
        return middle, within, between, own * float(np.quantile(z, QUANTILE)) + (1 - own) * others[3]

    whole = told(seen, (*_spread(seen), NORMAL))
    return {None: whole} | {k: told(g, whole) for k, g in seen.groupby("lang")}


_MEASURE = T.StructType([T.StructField("n", T.LongType()), T.StructField("mean", T.DoubleType()), T.StructField("square", T.DoubleType()), T.StructField("excess", T.DoubleType()), T.StructField("threshold", T.DoubleType())])


def measured(docs: DataFrame, model: Model, to: str = "quality") -> DataFrame:
    """docs and a struct of the whole text's tokens (n, the end included), their mean surprise and mean square in log10, the excess over
    the language and its threshold, in a column named to, which replaces one of that name.

    Null text counts as empty, a null or unknown lang takes the threshold of all; very long texts are measured whole; ties and repeated rows are measured
    alike; other columns pass through; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(_MEASURE)
    def measure(text: pd.Series, lang: pd.Series) -> pd.DataFrame:
        m, rows = shared.value, []
        for x, k in zip(text, lang, strict=True):
            p = -m.tokens(x) if m.words else np.zeros(1)
            mean = float(p.mean())
            z, t = m.excess(k, len(p), mean) if m.by_lang else (0.0, float("inf"))
            rows.append((len(p), mean, float((p * p).mean()), float(z), t))
        return pd.DataFrame(rows, columns=["n", "mean", "square", "excess", "threshold"])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.withColumn(to, measure(F.col("text"), lang))


_SEEN = ("__n", "__mean", "__square", "__sets")


def _thresholds_of(seen: DataFrame) -> dict:
    """What _thresholds gives, from any number of rows (lang, n, mean, square): exact quantiles, by aggregation; a row for each language is collected."""
    seen = written(seen.select("lang", "n", "mean", "square"), "seen")
    twice = seen.where("lang is not null").withColumn("all", F.lit(False)).unionByName(seen.withColumn("lang", F.lit(None).cast("string")).withColumn("all", F.lit(True)))
    spark, key = seen.sparkSession, ["all", "lang"]

    def joined(rows: list[tuple], names: str) -> DataFrame:
        more = spark.createDataFrame(rows, f"of_all boolean, of_lang string, {names}")
        return twice.join(F.broadcast(more), (F.col("all") == F.col("of_all")) & F.col("lang").eqNullSafe(F.col("of_lang")))

    half = lambda c: F.percentile(c, F.lit(0.5))
    tokens = F.sum("n")
    sums = twice.groupBy(*key).agg(F.count("*").alias("docs"), (F.sum(F.col("square") * F.col("n")) / tokens - F.pow(F.sum(F.col("mean") * F.col("n")) / tokens, F.lit(2.0))).alias("within"), half("n").alias("least")).collect()
    if not sums:
        return {}
    within = {r["lang"]: max(r["within"], 1e-6) for r in sums}
    middles = joined([(r["all"], r["lang"], float(r["least"])) for r in sums], "least double").where("n >= least").groupBy("lang").agg(half("mean").alias("v")).collect()
    middle = {r["lang"]: r["v"] for r in middles}
    apart = joined([(r["all"], r["lang"], middle[r["lang"]], within[r["lang"]]) for r in sums], "middle double, within double")
    apart = apart.groupBy("lang").agg(half(F.pow(F.col("mean") - F.col("middle"), F.lit(2.0)) / 0.455 - F.col("within") / F.col("n")).alias("v")).collect()
    between = {r["lang"]: max(r["v"], 1e-4) for r in apart}
    own = {r["lang"]: r["docs"] / (r["docs"] + PRIOR) for r in sums}
    spread = {k: (middle[k], within[k], between[k]) for k in within}
    told = {k: tuple(own[k] * x + (1 - own[k]) * y for x, y in zip(v, spread[None], strict=True)) for k, v in spread.items()}
    z = (F.col("mean") - F.col("middle")) / F.sqrt(F.col("within") / F.col("n") + F.col("between"))
    high = joined([(r["all"], r["lang"], *told[r["lang"]]) for r in sums], "middle double, within double, between double").groupBy("lang").agg(F.percentile(z, F.lit(QUANTILE)).alias("v")).collect()
    high = {r["lang"]: r["v"] for r in high}
    whole = own[None] * high[None] + (1 - own[None]) * NORMAL
    return {k: (*told[k], whole if k is None else own[k] * high[k] + (1 - own[k]) * whole) for k in told}


def scored(docs: DataFrame, judged: DataFrame, to: str = "quality", texts: bool = True) -> DataFrame:
    """docs (without texts the column text is dropped) and a struct as measured() gives it, in a column named to, under the model of all trusted texts, whole, which is counted and read in shards.

    Null text counts as empty, a null or unknown lang takes the threshold of all; very long texts are measured whole; ties and repeated rows are measured
    alike; other columns pass through; without trusted rows nothing is rejected; an empty table gives no rows.
    """
    names = free(docs, *_SEEN)
    n, mean, square, sets = map(F.col, names)
    parts = []
    with meanwhile(docs.sparkSession):
        for part in kneser_ney.measured(docs, _good(judged), _held(), _discounts, names):
            with meanwhile(docs.sparkSession) as passing:
                parts.append(written(part(texts), "measured"))
                passing.pop()  # the last one stays
    out = reduce(DataFrame.unionByName, parts)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    by_lang = _thresholds_of(out.where(sets).select(lang.alias("lang"), n.alias("n"), mean.alias("mean"), square.alias("square")))
    if not by_lang:
        of = F.struct(n.alias("n"), mean.alias("mean"), square.alias("square"), F.lit(0.0).alias("excess"), F.lit(float("inf")).alias("threshold"))
        return out.withColumn(to, of).drop(*names)
    it = free(out, "__of", "__middle", "__within", "__between", "__threshold")
    own = [(k, *map(float, v)) for k, v in by_lang.items() if k is not None]
    rows = docs.sparkSession.createDataFrame(own, ", ".join(f"`{c}` {'string' if c == it[0] else 'double'}" for c in it))
    both = out.join(F.broadcast(rows), lang == F.col(it[0]), "left")
    middle, within, between, threshold = (F.coalesce(F.col(c), F.lit(float(v))) for c, v in zip(it[1:], by_lang[None], strict=True))
    of = F.struct(n.alias("n"), mean.alias("mean"), square.alias("square"), ((mean - middle) / F.sqrt(within / n + between)).alias("excess"), threshold.alias("threshold"))
    return both.withColumn(to, of).drop(*names, *it)


def keep_good(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of docs whose excess perplexity is within their language's threshold; all columns as they were, whatever their names.

    Very long texts are measured whole. Null and empty texts have nothing against them and stay; repeated rows are treated alike; no labels, nothing rejected;
    an empty table gives no rows.
    """
    (q,) = free(docs, "measured")
    return scored(docs, judged, q).where(F.col(f"{q}.excess") <= F.col(f"{q}.threshold")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(documents(spark, sf_dir).select("doc_id", "text", "lang"), labels(spark, sf_dir), texts=False)
    q = F.col("quality")
    return out.select("doc_id", "lang", q["n"].alias("n_tokens"), F.pow(F.lit(10.0), q["mean"]).alias("perplexity"), q["excess"].alias("excess"), q["threshold"].alias("threshold"), (q["excess"] <= q["threshold"]).alias("keep"))
