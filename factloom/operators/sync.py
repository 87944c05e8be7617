"""Ledgers of peers that edit apart and exchange what they have: version vectors, and a union in which any order gives the same rows.

An edit is (item, peer, counter, value, seen): the counter-th edit of a peer to an item, and for each peer how many of its edits to the item the author had seen, its own earlier ones included.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDIT = ["item", "peer", "counter"]


def united(*ledgers: DataFrame) -> DataFrame:
    """All edits of the ledgers, each once: additive, and the same whatever the order and however often a ledger is taken.

    An edit that two ledgers hold with different contents is kept with the smaller one, and marked as tampered, for an author writes each counter once.
    """
    rows = reduce(DataFrame.unionByName, ledgers).withColumn("seen", F.map_from_entries(F.array_sort(F.map_entries("seen"))))
    body = F.struct(F.to_json(F.struct("value", F.map_entries("seen").alias("seen"))).alias("order"), F.col("value").alias("value"), F.map_entries("seen").alias("seen"))
    one = rows.groupBy(*EDIT).agg(F.min(body).alias("low"), F.max(body).alias("high"))
    return one.select(*EDIT, F.col("low.value").alias("value"), F.map_from_entries("low.seen").alias("seen"), (F.col("low.order") != F.col("high.order")).alias("tampered"))


def heads(ledger: DataFrame) -> DataFrame:
    """Edits that no other edit of their item has seen: one where all peers agree, more where they have edited at the same time.

    What has been seen of a peer is the greatest counter in any vector, so one pass over the vectors' entries decides and edits are never compared in pairs.
    """
    known = ledger.select("item", F.explode("seen").alias("peer", "upto")).groupBy("item", "peer").agg(F.max("upto").alias("upto"))
    return ledger.join(known, ["item", "peer"], "left").where(F.col("counter") > F.coalesce("upto", F.lit(0))).drop("upto")


def state(ledger: DataFrame) -> DataFrame:
    """(item, revision, value, heads, review): the revision is how many edits are known, so it only grows; the value that all heads have, or null with a review of what each of them says.

    Edits that a peer must have made but no ledger has are missing: then there is a review too, for what is not known may decide.
    """
    tops = heads(ledger)
    said = F.array_sort(F.collect_list(F.struct("peer", "counter", "value")))
    agreed = F.count_distinct(F.struct("value")) == 1
    now = tops.groupBy("item").agg(F.count("*").alias("heads"), F.when(agreed, F.max("value")).alias("value"), F.when(~agreed, F.lit("concurrent")).alias("review"), F.to_json(said).alias("said"), F.bool_or("tampered").alias("tampered"))
    # what is known of a peer's edits to an item has no gap up to the greatest counter, named or seen
    reach = ledger.select("item", "peer", F.col("counter").alias("upto"), F.lit(1).alias("n")).unionByName(ledger.select("item", F.explode("seen").alias("peer", "upto")).withColumn("n", F.lit(0)))
    gaps = reach.groupBy("item", "peer").agg((F.max("upto") - F.sum("n")).alias("gap"), F.sum("n").alias("n")).groupBy("item").agg(F.sum("n").alias("revision"), F.sum("gap").alias("missing"))
    review = F.when(F.col("tampered"), "tampered").when(F.col("missing") > 0, "missing edits").otherwise(F.col("review"))
    return now.join(gaps, "item").select("item", "revision", F.when(review.isNull(), F.col("value")).alias("value"), "heads", review.alias("review"), F.when(review.isNotNull(), F.col("said")).alias("said"))


def receive(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """The edits of theirs that mine lacks: what an exchange has to send."""
    return theirs.join(mine.select(*EDIT), EDIT, "left_anti")
