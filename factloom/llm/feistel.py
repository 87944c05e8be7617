"""Reproducible shuffle and shards: a Feistel permutation of global row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import documents, free

#: Steps of a cycle walk that are tried. The domain exceeds the rows by at most about two parts in the square root of the
#: rows, so that more steps than this do not occur; if they did, the job would stop and say so.
WALK = 64
ROUNDS = 8
#: Buckets of the row order. They are part of what a row number means, so neither the session nor the cluster may change them;
#: at 10 ** 10 rows each holds about 2.5 million, and the counts that are broadcast are one row for each.
BUCKETS = 4_096


def _round(value: Column, key: str, modulus: Column) -> Column:
    """A pseudo-random number below modulus: 60 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(key + ":"), value.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long") % modulus


def permuted(row: Column, rows: Column, seed: str = "factloom") -> Column:
    """The place, from 0 to rows - 1, of row number row: alternating Feistel rounds on a quotient and a remainder, walked
    along their cycle until they are inside. Null row or rows: null."""
    a = F.ceil(F.sqrt(rows.cast("double"))).cast("long")
    b = F.ceil(rows / a).cast("long")

    def left(key: str):
        return lambda s: F.struct(((s["l"] + _round(s["r"], key, a)) % a).alias("l"), s["r"].alias("r"))

    def right(key: str):
        return lambda s: F.struct(s["l"].alias("l"), ((s["r"] + _round(s["l"], key, b)) % b).alias("r"))

    def step(x: Column) -> Column:
        state = F.array(F.struct((x / b).cast("long").alias("l"), (x % b).alias("r")))
        for i in range(ROUNDS):
            state = F.transform(state, (right if i % 2 else left)(f"{seed}:{i}"))
        return F.transform(state, lambda s: s["l"] * b + s["r"])[0]

    first = step(row)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda x, _: F.when(x < rows, x).otherwise(step(x)))
    place = F.when(first < rows, first).otherwise(walked)
    return F.when(place < rows, place).when(row.isNull() | rows.isNull(), F.lit(None).cast("long")).otherwise(F.raise_error(F.lit("cycle walk too long: use another seed")).cast("long"))


def numbered(df: DataFrame, order: list[str], to: str = "row_no", of: str = "n_rows") -> DataFrame:
    """df with gapless global row numbers from 0 in the given order, and the number of rows; columns named so are replaced.

    Rows are spread over BUCKETS by the hash of the order columns, numbered inside each bucket, and shifted by the counts of
    the buckets before it, so the order is by bucket and then by order: no sort on one task, and the same rows
    give the same numbers, whatever the session's partitions are. Rows that are equal in the order columns exchange their numbers
    freely; no rows, no numbers.
    """
    bucket, held, before, at = free(df, "bucket", "held", "before", "at")
    df = df.drop(to, of) if {to, of} & set(df.columns) - set(order) else df
    keyed = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(BUCKETS)))
    counts = keyed.groupBy(bucket).agg(F.count("*").alias(held))
    ends = counts.withColumn(before, F.coalesce(F.sum(held).over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ends = ends.withColumn(of, F.sum(held).over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).drop(held)
    inside = keyed.withColumn(at, F.row_number().over(Window.partitionBy(bucket).orderBy(*order)))
    return inside.join(F.broadcast(ends), bucket).withColumn(to, F.col(before) + F.col(at) - 1).drop(bucket, before, at)


def shards(docs: DataFrame, n_shards: int = 8, seed: str = "factloom") -> DataFrame:
    """One row (doc_id, size, text_crc32, row_no, place, shard, slot) per row of docs (doc_id, text).

    Rows are numbered over the whole table, permuted, and dealt in turn: shard is place modulo n_shards and slot the
    quotient, so shards differ by at most one row and each slot can be computed from the row number. The same table has the same
    shards and slots in every session. A null text has no bytes (size 1, CRC 0) as an empty one; a null doc_id is numbered like any
    other; ties and repeated rows are equal in all columns read, so their numbers may be exchanged; a very long text counts by its
    size alone; an empty table gives no rows. Other columns are not read.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    slim = docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    rows = numbered(slim, ["doc_id", "text_crc32", "size"])
    placed = rows.withColumn("place", permuted(F.col("row_no"), F.col("n_rows"), seed)).drop("n_rows")
    return placed.withColumn("shard", (F.col("place") % n_shards).cast("int")).withColumn("slot", F.floor(F.col("place") / n_shards).cast("long"))


def op7_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards(documents(spark, sf_dir), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_no")
