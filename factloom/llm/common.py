"""What the training-data operators share: tables, the shared scratch folder, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the word separator of the contracts.
SPACE = r"[\x20\x09-\x0D]+"

#: Text cut as byte-level BPE sees it: a run of non-space with at most one space before it, or white space.
_WS = "\t-\r \x85\xa0  -     　"
CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one, which spark.checkpoint.dir names or the session has set as its checkpoint folder.

    A local master may do without and gets a temporary one, as in tests. A cluster may not, for a folder of one machine loses rows without a word.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="factloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/factloom-{uuid.uuid4().hex}"


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it differ from all columns of df, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Whether Spark removes a query's shuffle files as soon as the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: For each open meanwhile() the folders of tables that go when it ends.
_PASSING: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


@contextlib.contextmanager
def meanwhile(spark: SparkSession):
    """Tables that are written() inside are deleted at its end, but for those that stay; nothing may rest on them later that is not written. Gives the list of their folders."""
    folders: list[str] = []
    token = _PASSING.set((*_PASSING.get(), folders))
    try:
        yield folders
    finally:
        _PASSING.reset(token)
        for folder in folders:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str, codec: str = "zstd", stays: bool = False) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, so a lost executor costs a read. The shuffle files of the writing go with it.

    Inside a meanwhile() the table goes at its end; one that stays outlives the innermost of them.
    """
    spark = df.sparkSession
    base, before = scratch(spark), spark.conf.get(CLEANUP, None)
    path, passing = f"{base}/{label}", _PASSING.get()[: -1 if stays else None]
    if passing:
        passing[-1].append(base)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Rows and bytes that a Python worker is handed at a time.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1_000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, for whole texts are long; smaller bounds that are set already stay."""
    for key, most in BATCH.items():
        now = str(spark.conf.get(key)).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Returns memory that was freed to the system, for a driver goes on for long after a model's training, and a worker after a group."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def thrifty(f: Callable) -> Callable:
    """f, of one table or two, for a Python worker, which gives the memory of its work back after each group: workers stay for other work, beside one another."""

    def one(table):
        try:
            return f(table)
        finally:
            give_back()

    def two(table, other):
        try:
            return f(table, other)
        finally:
            give_back()

    return two if f.__code__.co_argcount == 2 else one


def checkpointed(df: DataFrame) -> DataFrame:
    if not df.sparkSession.sparkContext.getCheckpointDir():
        scratch(df.sparkSession)
    return df.checkpoint(eager=True)


def id_crc(doc_id: Column) -> Column:
    """crc32 of doc_id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


#: A key is hot that more than LEAST rows and one in HUBS of all hold, so there are at most HUBS of them; they are met by broadcast.
HUBS, LEAST = 1_000, 1_000


def joined_by_size(rows: DataFrame, one: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows joined to one, which has one row for each key (on) and, as n, how many of the total rows hold it; n is dropped. one should be a written table.

    Hot keys are broadcast, so that no task gets all rows of one; the others are shuffled.
    """
    hot = F.col("n") > max(total // HUBS, LEAST)
    if one.where(hot).isEmpty():
        return rows.join(one.drop("n"), on)
    few = F.broadcast(one.where(hot).drop("n"))
    return rows.join(few, on).unionByName(rows.join(few, on, "left_anti").join(one.where(~hot).drop("n"), on))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (u, v): one row (node, root) per node, root the smallest node of its component.

    Alternates the large-star and small-star steps until the edges no longer change; each round is O(edges)
    and the number of rounds is logarithmic. The hubs of large components are met by broadcast. Self-loops and repeated edges are allowed; no edges, no rows.
    """
    e = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state, total = None, 2 * e.count()
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = checkpointed(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = checkpointed(joined_by_size(both.where("v > u"), low, ["u"], total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        small_low = checkpointed(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = joined_by_size(large, small_low, ["u"], total).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.*")
        e = checkpointed(small.where("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state, total = now, 2 * now[0]
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
