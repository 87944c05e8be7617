"""Decisions about newer contents, from the contents' digests and not from flags: candidates against what is held, and fetches against what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconciled(held: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, choice, digest) of held (id, base, current, revision) and candidates (id, digest, revision): what becomes of each id, and the digest that it has then.

    keep: no candidate, or one that says what is held already or what it began from; stale: it was made from another revision; adopt: only the candidate has changed; merge: both have, differently, and a
    person has to look, so the current stays; new: nothing is held. Of several candidates of an id the one of the highest revision counts, of equals the smaller digest.
    """
    best = candidates.groupBy("id").agg(F.min(F.struct((-F.col("revision")).alias("order"), F.col("digest").alias("offered"))).alias("c"))
    rows = held.join(best, "id", "full")
    offered, made = F.col("c.offered"), -F.col("c.order")
    choice = (
        F.when(F.col("revision").isNull(), "new").when(F.col("c").isNull() | offered.isNull() | (offered == F.col("current")) | (offered == F.col("base")), "keep")
        .when(~made.eqNullSafe(F.col("revision")), "stale").when(F.col("base").eqNullSafe(F.col("current")), "adopt").otherwise("merge")
    )
    return rows.select("id", choice.alias("choice"), F.when(choice.isin("adopt", "new"), offered).otherwise(F.col("current")).alias("digest"))


def checked(stored: DataFrame, fetches: DataFrame) -> DataFrame:
    """(id, outcome, digest, checked_at) of stored (id, digest, checked_at) after fetches (id, at, status, content): the last fetch of each id decides.

    failed: a status of 400 or more, none, or no content, and what is stored stays as it was; first: nothing was stored; unchanged: the content has the digest that is stored; changed: it has another. Ids without
    a fetch are unasked, fetches of unknown ids are first.
    """
    last = fetches.groupBy("id").agg(F.max(F.struct("at", "status", F.sha2(F.col("content").cast("binary"), 256).alias("now"))).alias("f"))
    rows = stored.join(last, "id", "full")
    now = F.col("f.now")
    bad = F.coalesce(F.col("f.status") >= 400, F.lit(True)) | now.isNull()
    outcome = F.when(F.col("f").isNull(), "unasked").when(bad, "failed").when(F.col("digest").isNull(), "first").when(F.col("digest") == now, "unchanged").otherwise("changed")
    fresh = outcome.isin("first", "unchanged", "changed")
    return rows.select("id", outcome.alias("outcome"), F.when(fresh, now).otherwise(F.col("digest")).alias("digest"), F.when(fresh, F.col("f.at")).otherwise(F.col("checked_at")).alias("checked_at"))
