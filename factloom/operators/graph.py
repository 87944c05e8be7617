"""Graphs of dependencies and versions: closures, gates, cycles, three-way merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.sources.scratch import cut


def closure(edges: DataFrame) -> DataFrame:
    """All (node, reached, depth) over edges (src, dst), depth the least number of steps from 1. Cycles are allowed, and paths of any length.

    Each round doubles the paths: pairs that are exactly as far apart as the rounds so far reach are extended by all pairs found, so the rounds are
    logarithmic in the longest path and only pairs that are new are written.
    """
    found = cut(edges.select(F.col("src").alias("node"), F.col("dst").alias("reached")).distinct().withColumn("depth", F.lit(1)))
    far = 1
    while True:
        front = found.where(F.col("depth") == far).select("node", F.col("reached").alias("middle"))
        rest = found.select(F.col("node").alias("middle"), F.col("reached"), "depth")
        step = front.join(rest, "middle").groupBy("node", "reached").agg((F.min("depth") + far).alias("depth"))
        new = cut(step.join(found, ["node", "reached"], "left_anti").select("node", "reached", "depth"))
        if new.isEmpty():
            return found
        found, far = found.unionByName(new), 2 * far


def reach(seeds: DataFrame, edges: DataFrame, ways: str = "both") -> DataFrame:
    """The seeds (id) and every node (id) that paths over edges (src, dst) lead to from them: forwards ("out"), backwards ("in") or both ways.

    A search from the seeds: each round extends the nodes found last by one edge, so only edges at those are read on.
    """
    there, back = edges.select("src", "dst"), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    steps = cut({"out": there, "in": back, "both": there.unionByName(back)}[ways].distinct())
    found = new = cut(seeds.select("id").distinct())
    while True:
        step = new.join(steps, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        new = cut(step.join(found, "id", "left_anti"))
        if new.isEmpty():
            return found
        found = found.unionByName(new)


#: Peeling goes on while a round takes at least this share of the edges.
PEELED = 1 / 16


def cyclic(edges: DataFrame) -> DataFrame:
    """Nodes (id) that lie on a cycle of edges (src, dst): edges at nodes without a way in or out are peeled off round by round while that takes a good share of them,
    and what is left, cycles and what joins them, is closed."""
    left = cut(edges.select("src", "dst").distinct())
    size = left.count()
    while size:
        left = cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        before, size = size, left.count()
        if before - size < PEELED * before:
            break
    return closure(left).where("node = reached").select(F.col("node").alias("id"))


def ready(nodes: DataFrame, edges: DataFrame, accepted: Column) -> DataFrame:
    """Nodes (id) that are accepted and whose dependencies (src depends on dst) are all ready; a cycle or a missing dependency blocks.

    Nodes that are blocked are found, not those that are ready: what is not accepted, misses a dependency or is on a cycle blocks all that depends on it
    in any number of steps.
    """
    n = nodes.select("id", accepted.alias("ok"))
    e = edges.select("src", "dst").distinct()
    missing = e.join(n.select(F.col("id").alias("dst")), "dst", "left_anti").select(F.col("src").alias("id"))
    bad = n.where("not coalesce(ok, false)").select("id").unionByName(missing).unionByName(cyclic(e))
    return n.select("id").join(reach(bad, e, "in"), "id", "left_anti")


def heads(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes (id) that no other node points to as its parent (src: child, dst: parent)."""
    return nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def merge3(base: DataFrame, current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Three versions of (keys, value) merged by key: a side that alone has changed wins, equal changes are one, others conflict and keep the current.
    A key that a version lacks is absent there, which is not the same as a null value."""
    side = lambda df, s: df.select(*keys, F.struct(F.col("value")).alias(s))
    rows = side(base, "__base").join(side(current, "__cur"), keys, "full").join(side(incoming, "__inc"), keys, "full")
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    outcome = F.when(same("__cur", "__inc"), "same").when(same("__base", "__inc"), "auto_current").when(same("__base", "__cur"), "auto_incoming").otherwise("conflict")
    kept = F.when(outcome == "auto_incoming", F.col("__inc")).otherwise(F.col("__cur"))
    return rows.select(*keys, outcome.alias("outcome"), kept["value"].alias("value"), kept.isNotNull().alias("present"))


def leaf_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose value differs, with both values: (keys, old, new)."""
    o, n = old.select(*keys, F.col("value").alias("old")), new.select(*keys, F.col("value").alias("new"))
    return o.join(n, keys, "full").where(~F.col("old").eqNullSafe(F.col("new")))


def outline(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes (id) with their parent (edges src: child, dst: parent) and their number of children."""
    kids = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("children"))
    return nodes.join(edges.select(F.col("src").alias("id"), F.col("dst").alias("parent")), "id", "left").join(kids, "id", "left").select("id", "parent", F.coalesce("children", F.lit(0)).alias("children"))


def preview(now: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """The steps (keys, action, value) that lead from one capture (keys, value) to another: add, replace, remove; value is the other's."""
    a, b = now.select(*keys, F.struct("value").alias("a")), other.select(*keys, F.struct("value").alias("b"))
    action = F.when(F.col("a").isNull(), "add").when(F.col("b").isNull(), "remove").when(~F.col("a").eqNullSafe(F.col("b")), "replace")
    return a.join(b, keys, "full").select(*keys, action.alias("action"), F.col("b.value").alias("value")).where("action is not null")


def applied(now: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """A capture after steps of preview(). Steps that were taken before change nothing, so what was broken off can be taken up again."""
    kept = now.select(*keys, "value").join(steps.select(*keys), keys, "left_anti")
    return kept.unionByName(steps.where("action <> 'remove'").select(*keys, "value"))
