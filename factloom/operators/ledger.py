"""Change feeds and append-only ledgers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def feed_page(log: DataFrame, cursor: int, limit: int = 1000) -> DataFrame:
    """Events after cursor in sequence, limit at most, with has_more and the cursor to go on from."""
    rows = log.where(F.col("seq") > cursor).orderBy("seq").limit(limit + 1)
    n = F.row_number().over(Window.orderBy("seq"))
    whole = Window.partitionBy()
    numbered = rows.withColumn("__n", n).withColumn("has_more", F.count("*").over(whole) > limit).where(F.col("__n") <= limit)
    return numbered.withColumn("next_cursor", F.max("seq").over(whole)).drop("__n")


def changes(previous: DataFrame, current: DataFrame, key: str, value: str, alive: Column | None = None) -> DataFrame:
    """Events that lead from one state to the next: add, replace, suspend, withdraw. alive, over current, says which rows are in force."""
    p = previous.select(key, F.col(value).alias("old"))
    c = current.select(key, F.col(value).alias("new"), (F.lit(True) if alive is None else alive).alias("alive"))
    kind = F.when(F.col("alive").isNull(), "withdraw").when(~F.col("alive"), "suspend").when(F.col("old").isNull(), "add").when(~F.col("old").eqNullSafe(F.col("new")), "replace")
    return p.join(c, key, "full").withColumn("kind", kind).where("kind is not null").select(key, "kind", "old", "new")


def receipts(requests: DataFrame, order: list[str]) -> DataFrame:
    """requests (id, digest) in order: the first of an id is applied, one with its digest is a replay, another a conflict."""
    w = Window.partitionBy("id").orderBy(*order)
    first = F.first("digest").over(w)
    return requests.withColumn("outcome", F.when(F.row_number().over(w) == 1, "applied").when(F.col("digest") == first, "replay").otherwise("conflict"))


def guarded(updates: DataFrame, key: str, order: list[str], expected: str) -> DataFrame:
    """Updates with accepted and revision, the revision that their key has after them. An update is accepted where it expects the revision that the key has, 0 at first; only then does that rise.

    What is refused is kept, with the revision that it failed on, so that a conflict can be settled. A null expectation is refused. Keys are dealt out and read in order, with one number held for the key at hand.
    """
    kind = T.StructType([*updates.schema.fields, T.StructField("accepted", T.BooleanType()), T.StructField("revision", T.LongType())])

    def fold(batches):
        now, revision = None, 0
        for pdf in batches:
            accepted, revisions = [], []
            for k, e in zip(pdf[key], pdf[expected], strict=True):
                if k != now:
                    now, revision = k, 0
                fine = not pd.isna(e) and int(e) == revision
                revision += fine
                accepted.append(fine)
                revisions.append(revision)
            yield pdf.assign(accepted=accepted, revision=revisions)

    return updates.repartition(key).sortWithinPartitions(key, *order).mapInPandas(fold, kind)


def heads(ledger: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last entry of each key, whole."""
    columns = [c for c in ledger.columns if c != key]
    return ledger.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__last")).select(key, "__last.*")


def content_changes(log: DataFrame, key: str, order: list[str], digest: str) -> DataFrame:
    """Entries with INITIAL, CHANGED or UNCHANGED against the entry before."""
    before = F.lag(digest).over(Window.partitionBy(key).orderBy(*order))
    return log.withColumn("change", F.when(before.isNull(), "INITIAL").when(before != F.col(digest), "CHANGED").otherwise("UNCHANGED"))


def chained(stages: list[Column]) -> list[Column]:
    """Signatures of stages, each over its own input and the signature before it."""
    out: list[Column] = []
    for s in stages:
        out.append(F.sha2(F.concat_ws("|", *([out[-1]] if out else []), s), 256))
    return out


def appended(asked: DataFrame, key: str, order: str) -> DataFrame:
    """Changes (key, order, value, expected) taken in their order onto a ledger for each key that begins at revision 1: (key, order, value, accepted, revision).

    A change is accepted where it expects the revision that the ledger has and its value is a number above 0 and up to 1. Each acceptance depends on those before
    it, so that a key's changes, which people make one by one, are folded in one place.
    """
    rows = asked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("value").cast("double").alias("v"), F.col("expected").cast("long").alias("e")))).alias("items"))

    def fold(batches):
        for pdf in batches:
            out: dict[str, list] = {key: [], order: [], "value": [], "accepted": [], "revision": []}
            for k, items in zip(pdf[key], pdf["items"], strict=True):
                revision = 1
                for x in items:
                    fine = x["e"] == revision and x["v"] is not None and 0 < x["v"] <= 1
                    revision += fine
                    for name, value in zip(out, (k, x["o"], x["v"], fine, revision), strict=True):
                        out[name].append(value)
            yield pd.DataFrame(out)

    schema = T.StructType([asked.schema[key], asked.schema[order], T.StructField("value", T.DoubleType()), T.StructField("accepted", T.BooleanType()), T.StructField("revision", T.LongType())])
    return rows.mapInPandas(fold, schema)


def compared(one: DataFrame, two: DataFrame) -> DataFrame:
    """(checked, differences): the rows of one, and those that either has more often than the other, repeats counted."""
    sign = one.withColumn("__n", F.lit(1)).unionByName(two.withColumn("__n", F.lit(-1)))
    net = sign.groupBy(*one.columns).agg(F.sum("__n").alias("net"), F.count_if(F.col("__n") > 0).alias("held"))
    return net.agg(F.coalesce(F.sum("held"), F.lit(0)).alias("checked"), F.coalesce(F.sum(F.abs("net")), F.lit(0)).alias("differences"))
