"""The folder that all executors share: checkpoints and tables between steps."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the session's checkpoint folder. A local master may do without, and gets a temporary one, as in tests; a cluster may not."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="factloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return base.rstrip("/")


def fresh(spark: SparkSession) -> str:
    """A path below it that nothing else uses."""
    return f"{folder(spark)}/factloom-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage ended in that folder."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows and bytes that a Python worker is handed at a time.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 500, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, for files and pages are long; smaller bounds that are set already stay."""
    for key, most in BATCH.items():
        now = str(spark.conf.get(key)).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
