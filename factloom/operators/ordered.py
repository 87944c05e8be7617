"""Ordered operators: ranks, runs, carries and folds over rows in a given order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.sources.scratch import cut


def ranked(rows: DataFrame, order: list[Column], to: str) -> DataFrame:
    """Rows with their place from 1 in one order over the whole table: ranges are sorted apart and shifted by the counts before them.

    The ranges are written to the checkpoint folder once, since bounds that are sampled anew could differ.
    """
    cols = [f"__o{i}" for i in range(len(order))]
    keyed = rows.withColumns(dict(zip(cols, order, strict=True)))
    ranges = cut(keyed.repartitionByRange(*cols).withColumn("__p", F.spark_partition_id()))
    inside = ranges.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy(*cols)))
    counts = ranges.groupBy("__p").agg(F.count("*").alias("__c"))
    before = counts.withColumn("__b", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__b")
    return inside.join(F.broadcast(before), "__p").withColumn(to, F.col("__b") + F.col("__n")).drop("__p", "__n", "__b", *cols)


def runs(rows: DataFrame, partition: list[str], order: list[str], breaks: Column, to: str = "run") -> DataFrame:
    """Rows with the number of their run from 1: a run begins where breaks holds, and at the first row."""
    w = Window.partitionBy(*partition).orderBy(*order)
    first = F.row_number().over(w) == 1
    return rows.withColumn("__new", F.when(first | breaks, 1).otherwise(0)).withColumn(to, F.sum("__new").over(w)).drop("__new")


def islands(rows: DataFrame, partition: list[str], value: str) -> DataFrame:
    """Runs of consecutive integers per partition: (start, end, n)."""
    distinct = rows.select(*partition, value).distinct()
    base = F.col(value) - F.row_number().over(Window.partitionBy(*partition).orderBy(value))
    return distinct.withColumn("__base", base).groupBy(*partition, "__base").agg(F.min(value).alias("start"), F.max(value).alias("end"), F.count("*").alias("n")).drop("__base")


def heading_paths(blocks: DataFrame, document: str, order: str, levels: int) -> DataFrame:
    """Blocks with the titles of the headings above them: per level the last heading that no heading of the same or a higher rank has ended."""
    w = Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = blocks
    for k in range(1, levels + 1):
        at = F.when((F.col("kind") == "heading") & (F.col("level") <= k), F.struct(F.col("level").alias("l"), "id"))
        out = out.withColumn(f"__h{k}", F.last(at, ignorenulls=True).over(w))
    path = F.array_compact(F.array(*[F.when(F.col(f"__h{k}.l") == k, F.col(f"__h{k}.id").cast("string")) for k in range(1, levels + 1)]))
    return out.withColumn("path", F.array_join(path, "/")).drop(*[f"__h{k}" for k in range(1, levels + 1)])


def packed_chunks(blocks: DataFrame, document: str, order: str, size: Column, limit: int, starts: Column | None = None, alone: Column | None = None) -> DataFrame:
    """(document, order, size, chunk): blocks with the number of their chunk, from 0. A chunk closes before the block that would take it over limit and before
    one that starts a chunk; one that stands alone closes it on both sides.

    What a chunk holds is known only from those before it, so each document is folded once, by a running sum.
    """
    no = F.lit(False)
    rows = blocks.select(document, F.struct(F.col(order).alias("o"), size.cast("long").alias("n"), (no if starts is None else starts).alias("starts"), (no if alone is None else alone).alias("alone")).alias("b"))
    place, kind = rows.schema["b"].dataType["o"].dataType, rows.schema[document]

    def numbered(batches):
        for pdf in batches:
            out: dict[str, list] = {document: [], order: [], "size": [], "chunk": []}
            for doc, items in zip(pdf[document], pdf["items"], strict=True):
                chunk, held, open_ = 0, 0, False
                for b in items:
                    if open_ and (b["starts"] or b["alone"] or held + b["n"] > limit):
                        chunk, held = chunk + 1, 0
                    for name, value in zip(out, (doc, b["o"], b["n"], chunk), strict=True):
                        out[name].append(value)
                    held, open_ = held + b["n"], True
                    if b["alone"]:
                        held = limit + 1
            yield pd.DataFrame(out)

    grouped = rows.groupBy(document).agg(F.array_sort(F.collect_list("b")).alias("items"))
    return grouped.mapInPandas(numbered, T.StructType([kind, T.StructField(order, place), T.StructField("size", T.LongType()), T.StructField("chunk", T.IntegerType())]))


def greedy_intervals(spans: DataFrame, key: str) -> DataFrame:
    """Per key the spans (start, end) kept when taken by start and then by length, longest first, each unless it overlaps one kept before."""
    items = F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("s"), (-(F.col("end") - F.col("start"))).cast("long").alias("l"), F.col("end").cast("long").alias("e"))))

    def kept(batches):
        for pdf in batches:
            out: dict[str, list] = {key: [], "start": [], "end": []}
            for k, spans_of in zip(pdf[key], pdf["items"], strict=True):
                reach = None
                for x in spans_of:
                    if reach is None or x["s"] >= reach:
                        reach = x["e"]
                        for name, value in zip(out, (k, x["s"], x["e"]), strict=True):
                            out[name].append(value)
            yield pd.DataFrame(out)

    grouped = spans.groupBy(key).agg(items.alias("items"))
    return grouped.mapInPandas(kept, T.StructType([spans.schema[key], T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def merged_spans(spans: DataFrame, key: str) -> DataFrame:
    """Unions of overlapping or touching spans (start, end) per key."""
    w = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    groups = spans.withColumn("__new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)).withColumn("__g", F.sum("__new").over(w))
    return groups.groupBy(key, "__g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__g")


def residual_spans(whole: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """What of whole (key, length) no span covers, as spans."""
    covered = merged_spans(spans, key)
    ends = covered.select(key, "start", "end").unionByName(whole.select(key, F.col("length").cast("long").alias("start"), F.col("length").cast("long").alias("end")))
    w = Window.partitionBy(key).orderBy("start", "end")
    gaps = ends.select(key, F.coalesce(F.lag("end").over(w), F.lit(0)).alias("gap"), F.col("start").alias("upto"))
    return gaps.where("upto > gap").select(key, F.col("gap").alias("start"), F.col("upto").alias("end"))
