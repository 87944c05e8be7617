"""Streams over event files: a job state machine, projections kept per batch, and receipts without repeats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The states of a job and what may follow each.
NEXT = {"": ("queued",), "queued": ("running",), "running": ("done", "failed"), "failed": ("queued",), "done": ("queued",)}
RETRIES = 3

JOBS = T.StructType([T.StructField("item", T.LongType()), T.StructField("state", T.StringType()), T.StructField("retries", T.LongType()), T.StructField("refused", T.LongType())])
_STATE = T.StructType(JOBS.fields[1:])


def advance(state: str, retries: int, refused: int, wanted: list[str]) -> tuple[str, int, int]:
    """A job's state after wanted states in turn: those that may not follow, and retries beyond the limit, are refused and counted."""
    for x in wanted:
        again = state == "failed" and x == "queued"
        if x not in NEXT[state] or again and retries >= RETRIES:
            refused += 1
        else:
            state, retries = x, retries + again
    return state, retries, refused


def _job(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = state.get if state.exists else ("", 0, 0)
    rows = pd.concat(list(batches)).sort_values("seq")
    held = advance(held[0], int(held[1]), int(held[2]), rows["wanted"].tolist())
    state.update(held)
    yield pd.DataFrame([(key[0], *held)], columns=JOBS.fieldNames())


def job_states(events: DataFrame) -> DataFrame:
    """Streaming (item, seq, wanted) to the state of each job that a micro-batch touches."""
    return events.groupBy("item").applyInPandasWithState(_job, JOBS, _STATE, "update", GroupStateTimeout.NoTimeout)


def event_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """New Parquet files below path."""
    return spark.readStream.schema(schema).parquet(path)


def counted(events: DataFrame, watermark: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Streaming counts and sums per window and type; rows later than the watermark are left out."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def once(requests: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Streaming requests (id, ts), each id once while the watermark remembers it."""
    return requests.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["id"])


def projected(events: DataFrame, path: str, checkpoint: str):
    """Keeps the last event per item of each micro-batch as Parquet below path; a batch that is run again replaces its own output."""

    def keep(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("item").agg(F.max_by(F.struct("seq", "state"), "seq").alias("e")).select("item", "e.*")
        last.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def run_once(stream: DataFrame, path: str, mode: str = "update") -> DataFrame:
    """Everything a stream has to give now, as files below path with the number of their micro-batch; a batch that is run again replaces its own."""

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema.add("batch", "long")).parquet(f"{path}/rows")
