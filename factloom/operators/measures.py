"""Evaluation: multiset scores, error rates, calibration, gates and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def multiset(expected: DataFrame, actual: DataFrame, key: str, token: str) -> DataFrame:
    """Per key: tokens expected, actual and in common, counting repeats."""
    e = expected.groupBy(key, token).agg(F.count("*").alias("e"))
    a = actual.groupBy(key, token).agg(F.count("*").alias("a"))
    both = e.join(a, [key, token], "full").select(key, F.coalesce("e", F.lit(0)).alias("e"), F.coalesce("a", F.lit(0)).alias("a"))
    return both.groupBy(key).agg(F.sum("e").alias("expected"), F.sum("a").alias("actual"), F.sum(F.least("e", "a")).alias("common"))


def f1(common: Column, expected: Column, actual: Column) -> Column:
    """1 where both are empty, 0 where nothing is in common."""
    return F.when((expected == 0) & (actual == 0), 1.0).otherwise(2.0 * common / (expected + actual))


def multiset_difference(expected: DataFrame, actual: DataFrame, key: str, token: str) -> DataFrame:
    """(key, token, missing, extra) of tokens whose counts differ."""
    e = expected.groupBy(key, token).agg(F.count("*").alias("e"))
    a = actual.groupBy(key, token).agg(F.count("*").alias("a"))
    both = e.join(a, [key, token], "full").select(key, token, (F.coalesce("e", F.lit(0)) - F.coalesce("a", F.lit(0))).alias("d"))
    return both.where("d <> 0").select(key, token, F.greatest("d", F.lit(0)).alias("missing"), F.greatest(-F.col("d"), F.lit(0)).alias("extra"))


def char_error_rate(expected: Column, actual: Column) -> Column:
    n = F.char_length(expected)
    return F.when(n == 0, F.when(F.char_length(actual) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(expected, actual) / n)


def wilson(rows: DataFrame, score: str, correct: Column, bins: int = 20, z: float = 1.96) -> DataFrame:
    """Per score bin: n, correct, and the lower bound of the share of correct ones."""
    binned = rows.groupBy(F.least(F.lit(bins - 1), F.floor(F.col(score) * bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.count_if(correct).alias("correct"))
    n, p = F.col("n"), F.col("correct") / F.col("n")
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return binned.withColumn("confidence", F.greatest(low, F.lit(0.0)))


def gated(metrics: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """(metric, value) against thresholds: names that begin with max_ bound from above; a metric that is missing fails."""
    wanted = metrics.sparkSession.createDataFrame(list(thresholds.items()), "name string, threshold double")
    rows = wanted.withColumn("metric", F.regexp_replace("name", "^max_", "")).join(metrics, "metric", "left")
    ok = F.when(F.col("name").startswith("max_"), F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold"))
    return rows.select("name", "value", "threshold", F.coalesce(ok, F.lit(False)).alias("passed"))


def hash_sample(rows: DataFrame, key: Column, seed: str, n: int) -> DataFrame:
    """The n rows of least SHA-256 of seed and key."""
    return rows.withColumn("lot", F.sha2(F.concat(F.lit(seed + ":"), key.cast("string")), 256)).orderBy("lot").limit(n)


def stratified_with_fill(rows: DataFrame, positive: Column, key: Column, seed: str, quota: tuple[int, int] = (3, 2)) -> DataFrame:
    """Quotas of positive and negative rows in hash order; what one side lacks the other fills."""
    lot = F.sha2(F.concat(F.lit(seed + ":"), key.cast("string")), 256)
    drawn = rows.withColumn("lot", lot).withColumn("positive", positive)
    total = sum(quota)
    first = drawn.where("positive").orderBy("lot").limit(total).unionByName(drawn.where("not positive").orderBy("lot").limit(total))
    n = F.row_number().over(Window.partitionBy("positive").orderBy("lot"))
    ranked = first.withColumn("n", n).withColumn("filling", F.when(F.col("positive"), F.col("n") > quota[0]).otherwise(F.col("n") > quota[1]))
    return ranked.orderBy("filling", "lot").limit(total).drop("n")


def page(rows: DataFrame, order: list, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of rows in order, with the number of rows in all."""
    total = rows.agg(F.count("*").alias("total")).scalar()
    return rows.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)
