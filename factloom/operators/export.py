"""Exports of a governed table in versions: only what has changed is written, and a version counts only once its status is there.

A folder holds version=N/part=P/ for each part that version N wrote, and status/version=N, written last, with each part's version and digest. A run that was broken off leaves a version
without a status; the next run writes that version anew. A run over unchanged rows writes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATUS = "part int, version long, digest string, rows long"


def parts_of(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """rows with the part that their key belongs to, the same in every run."""
    return rows.withColumn("part", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(parts)).cast("int"))


def digests(rows: DataFrame) -> DataFrame:
    """(part, digest, rows): a digest of each part's rows that does not depend on their order, from sums of two hashes of each row as JSON, nulls included."""
    whole = F.to_json(F.struct(*[c for c in rows.columns if c != "part"]), {"ignoreNullFields": "false"})
    wide = lambda seed: F.sum(F.xxhash64(F.lit(seed), whole).cast("decimal(38,0)"))
    return rows.groupBy("part").agg(F.md5(F.concat_ws(":", wide("a").cast("string"), wide("b").cast("string"), F.count("*").cast("string")).cast("binary")).alias("digest"), F.count("*").alias("rows"))


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions that have a status, which Spark's file system sees wherever the folder is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/status")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/status/{n}/_SUCCESS")))


def status(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """(version, table of part, version, digest, rows) of the last version that was finished; 0 and no rows before the first."""
    done = _versions(spark, path)
    if not done:
        return 0, spark.createDataFrame([], STATUS)
    return done[-1], spark.read.schema(STATUS).parquet(f"{path}/status/version={done[-1]}")


def export(rows: DataFrame, path: str, key: str, parts: int = 64) -> tuple[int, int]:
    """(version, parts written): brings the folder up to rows. parts bounds how finely changes are told apart, not how much a part may hold."""
    spark = rows.sparkSession
    now, before = status(spark, path)
    dealt = parts_of(rows, key, parts)
    fresh = digests(dealt)
    old = before.select("part", F.col("version").alias("old_version"), F.col("digest").alias("old_digest"))
    both = fresh.join(old, "part", "full")
    # one row for each part, of which there are as many as the caller has asked for
    told = both.select("part", "digest", "rows", "old_version", F.coalesce(F.col("digest") != F.col("old_digest"), F.lit(True)).alias("changed")).collect()
    changed = [r["part"] for r in told if r["changed"] and r["digest"] is not None]
    if not any(r["changed"] for r in told):
        return now, 0
    version = now + 1
    if changed:
        dealt.where(F.col("part").isin(changed)).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/version={version}")
    left = [(r["part"], version if r["changed"] else r["old_version"], r["digest"], r["rows"]) for r in told if r["digest"] is not None]
    spark.createDataFrame(left, STATUS).coalesce(1).write.mode("overwrite").parquet(f"{path}/status/version={version}")
    return version, len(changed)


def exported(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the last finished version, each part from the version that wrote it last."""
    _, held = status(spark, path)
    each = [(r["version"], r["part"]) for r in held.select("version", "part").collect()]
    by: dict[int, list[int]] = {}
    for version, part in each:
        by.setdefault(version, []).append(part)
    frames = [spark.read.schema(f"{schema}, part int").parquet(f"{path}/version={v}").where(F.col("part").isin(ps)).drop("part") for v, ps in sorted(by.items())]
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], schema)


def state(path_version: Column, authority: Column, failed: Column) -> Column:
    """What a reader is told: failed, current or pending."""
    return F.when(failed, "failed").when(path_version == authority, "current").otherwise("pending")
