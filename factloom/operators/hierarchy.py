"""Trees of units with human edits over them: parents in effect, depth, root and cycles, by pointers that double their reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.sources.scratch import cut


def overlaid(source: DataFrame, edits: DataFrame) -> DataFrame:
    """(id, parent, edited): source (id, parent) with the last edit (id, parent, at) of each unit over it; an edit may take the parent away. Edits of unknown units do nothing."""
    last = edits.groupBy("id").agg(F.max_by(F.struct("parent"), F.struct("at", "parent")).alias("e"))
    rows = source.join(last, "id", "left")
    return rows.select("id", F.when(F.col("e").isNotNull(), F.col("e.parent")).otherwise(F.col("parent")).alias("parent"), F.col("e").isNotNull().alias("edited"))


def placed(tree: DataFrame) -> DataFrame:
    """(id, parent, depth, root, state) of a tree (id, parent): how many steps the root is away, and which it is.

    state is fine, unknown_parent where the way up ends at a unit that is not there (which then is the root), cycle for units that are their own ancestors, and below_cycle for those whose way up ends in one;
    the last two have neither depth nor root. Each unit holds one pointer, whose reach doubles with every round: as many rounds as the logarithm of the depth, each linear in the units, with no limit of depth.
    """
    nodes = tree.select("id", "parent")
    known = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    first = nodes.join(known, "parent", "left")
    # done: the pointer stands at the root; otherwise it stands dist steps up
    now = cut(first.select("id", F.when(F.col("there"), F.col("parent")).alias("up"), F.when(F.col("there"), 1).otherwise(F.when(F.col("parent").isNotNull(), 1).otherwise(0)).cast("long").alias("dist"), F.when(~F.coalesce("there", F.lit(False)), F.coalesce("parent", "id")).alias("root"), (F.col("parent").isNotNull() & F.col("there").isNull()).alias("lost")))
    size = (now.where("root is null").count(), -1)
    while size[0]:
        # a pointer at a unit that knows its root is done by it
        over = now.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("dist").alias("more"), F.col("root").alias("found"), F.col("lost").alias("gone"))
        step = now.where("root is null").join(over, "up")
        moved = step.select("id", F.when(F.col("found").isNull(), F.col("next")).alias("up"), (F.col("dist") + F.col("more")).alias("dist"), F.col("found").alias("root"), F.col("gone").alias("lost"))
        now = cut(now.where("root is not null").unionByName(moved))
        open_ = now.where("root is null")
        # pointers that go nowhere but round: their targets no longer get fewer
        before, size = size, tuple(open_.agg(F.count("*"), F.count_distinct("up")).first())
        if size == before:
            break
    ring = now.where("root is null").select(F.col("up").alias("id")).distinct().withColumn("ring", F.lit(True))
    rows = nodes.join(now.select("id", "dist", "root", "lost"), "id").join(ring, "id", "left")
    state = F.when(F.col("root").isNotNull(), F.when(F.col("lost"), "unknown_parent").otherwise("fine")).when(F.col("ring"), "cycle").otherwise("below_cycle")
    return rows.select("id", "parent", F.when(F.col("root").isNotNull(), F.col("dist")).alias("depth"), "root", state.alias("state"))


def ancestors(tree: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, ancestor, distance) of the asked seeds (id), nearest first; in a cycle each unit once. Each round climbs one step from all seeds, so rounds are as many as the deepest of them."""
    up = cut(tree.where("parent is not null").select(F.col("id").alias("ancestor"), F.col("parent").alias("next")))
    front = found = cut(seeds.select("id").distinct().join(up, F.col("id") == F.col("ancestor")).select("id", F.col("next").alias("ancestor"), F.lit(1).alias("distance")).where("id <> ancestor"))
    while True:
        step = front.join(up, "ancestor").select("id", F.col("next").alias("ancestor"), (F.col("distance") + 1).alias("distance")).where("id <> ancestor")
        front = cut(step.join(found, ["id", "ancestor"], "left_anti").select("id", "ancestor", "distance"))
        if front.isEmpty():
            return found
        found = found.unionByName(front)
