"""A written table does not keep the shuffle files that made it, and the session's own settings stay."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from factloom.llm.common import CLEANUP, written


def _shuffled(spark) -> int:
    top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(p.stat().st_size for d in top for p in Path(d).rglob("shuffle_*.data"))


def test_shuffle_files_go_when_a_table_is_written(spark):
    before, setting = _shuffled(spark), spark.conf.get(CLEANUP, None)
    rows = spark.range(200_000).groupBy((F.col("id") % 50_000).alias("k")).agg(F.sum(F.xxhash64("id") % 1000).alias("v"))
    table = written(rows, "sums")
    assert _shuffled(spark) <= before
    assert table.count() == 50_000
    assert spark.conf.get(CLEANUP, None) == setting
