"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import SPACE, documents

WIDTH = 5
#: One hash in SCALE is kept, of short texts and long ones alike.
SCALE = 4
#: Rows of a range of doc_id, and the most ranges: their borders are literals of the plan.
RANGE_ROWS, RANGES = 16_384, 1 << 16


def _threshold(scale: int) -> int:
    return -(1 << 63) + (1 << 64) // scale


def sketch(text: Column, width: int = WIDTH, scale: int = SCALE) -> Column:
    """Sorted distinct hashes (array of long) of the width-word shingles of the lower-cased text that lie in the lowest 1/scale of the hash range.

    Sketches merge by array_union into the sketch of the texts' joint shingles. A text of fewer words is one shingle; a text without
    words, or null, has an empty sketch, and so may a short one: scale times the sketch's size estimates how many shingles it stands for.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def shingled(h: Column) -> Column:
        n = F.size(h)
        return F.when(n == 0, F.array().cast("array<long>")).when(n < width, F.array(F.xxhash64(h))).otherwise(F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)])))

    once = F.transform(F.array(hashes), shingled)
    return F.transform(once, lambda s: F.array_sort(F.array_distinct(F.filter(s, lambda x: x < _threshold(scale)))))[0]


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller sketch that the other holds: an estimate of how much of the smaller text the larger contains.
    Equal sketches, empty ones too: 1; one of them empty: 0."""
    least = F.least(F.size(a), F.size(b))
    return F.when(a == b, F.lit(1.0)).when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def jaccard(a: Column, b: Column) -> Column:
    """Estimate of the share of shingles in common; as containment() where a sketch is empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(a == b, F.lit(1.0)).when(either == 0, F.lit(0.0)).otherwise(both / either)


def shown(s: Column) -> Column:
    return F.concat_ws("", F.transform(s, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))))


def sketches(docs: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """docs and a column sketch of the whole column text; columns of that name are replaced, all others pass through."""
    return docs.withColumn("sketch", sketch(F.col("text"), width, scale))


def _place(cuts: list[int], value: Column) -> Column:
    """How many of the sorted cuts are at most value: found among every k-th cut first, then among the k after it."""
    k = max(1, int(len(cuts) ** 0.5))
    below = lambda some, x: F.size(F.filter(some, lambda c: c <= x))
    coarse = below(F.lit(cuts[::k]), value)
    fine = F.array(*[F.lit(cuts[i : i + k]) for i in range(0, len(cuts), k)])
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * k + below(F.element_at(fine, coarse), value))


def with_next(docs: DataFrame, rows_a_range: int = RANGE_ROWS) -> DataFrame:
    """docs (doc_id, text) with the text that follows each in descending doc_id (next_text), after the last that of the first.

    Ranges of doc_id between quantiles are sorted each by itself, and the last row of one takes the first text of the nearest
    range below, so the texts are shuffled once and no order is made in one task: what is ordered as a whole are the numbers of the ranges.
    Ties in doc_id are ordered by the text's hash; a null doc_id comes last. A single row is followed by itself.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spark = docs.sparkSession
    n = min(RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // rows_a_range)))
    cuts = docs.where("doc_id is not null").select("doc_id").approxQuantile("doc_id", [i / n for i in range(1, n)], max(0.2 / n, 1e-5)) if n > 1 else []
    cuts = sorted({int(c) for c in cuts})
    place = _place(cuts, F.col("doc_id")) if cuts else F.lit(0)
    bucket = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(place)
    dealt = docs.withColumn("bucket", bucket)
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    inside = dealt.withColumn("next_text", F.lead("text").over(Window.partitionBy("bucket").orderBy(*order)))
    # the largest id of each range, and by it the range's first text; one row a range, RANGES at most
    tops = docs.groupBy(bucket.alias("bucket")).agg(F.max("doc_id").alias("top"))
    heads = docs.join(F.broadcast(tops), F.col("doc_id").eqNullSafe(F.col("top"))).groupBy("bucket").agg(F.min_by("text", F.xxhash64("text")).alias("first"))
    whole = Window.orderBy(F.col("bucket").desc())
    below = tops.select("bucket", F.coalesce(F.lead("bucket").over(whole), F.max("bucket").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("at"))
    follows = below.join(heads.select(F.col("bucket").alias("at"), F.col("first").alias("below")), "at").select("bucket", "below")
    return inside.join(follows, "bucket").select("doc_id", "text", F.coalesce("next_text", "below").alias("next_text"))


def edited(docs: DataFrame) -> DataFrame:
    """with_next() and n_chars and edited: the last floor(n_chars / 2) code points replaced by the first as many, or all, of next_text."""
    out = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    head = F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half)
    return out.withColumn("edited", F.concat(head, F.substring("next_text", F.lit(1), half)))


def compared(docs: DataFrame) -> DataFrame:
    """One row (doc_id, n_chars, edited_sha256, own, other, following) per row of docs (doc_id, text): the sketches of the text, of its edited text
    and of the next document's.

    Null text counts as empty; equal texts, however often repeated, have equal sketches; a very long text has a sketch in proportion; ties in doc_id are
    ordered by the text's hash; a single row is its own next; an empty table gives no rows. Other columns are not read.
    """
    return edited(docs).select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("text")).alias("own"), sketch(F.col("edited")).alias("other"), sketch(F.col("next_text")).alias("following"))


def op4_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compared(documents(spark, sf_dir))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("own")).alias("fingerprint"), shown(F.col("other")).alias("edited_fingerprint"),
        containment(F.col("own"), F.col("other")).alias("near_edited"), containment(F.col("own"), F.col("following")).alias("near_next"),
        jaccard(F.col("own"), F.col("other")).alias("jaccard_edited"), jaccard(F.col("own"), F.col("following")).alias("jaccard_next"),
        F.size("own").alias("sketch_size"), F.size("other").alias("edited_sketch_size"),
    )
