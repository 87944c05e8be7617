"""Matchings inside groups that are bounded by a page: greedy nearest, and largest one-to-one."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.sources.scratch import cut


#: Groups are dealt into buckets of about so many rows, so that a worker gets many small groups at a time and never a fixed share of the table.
BUCKETS, BUCKET_ROWS = 64, 100_000


def _bucket(rows: DataFrame, keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(max(BUCKETS, -(-rows.count() // BUCKET_ROWS))))


def nearest_one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Each row of left (id, x0, y0, i), by i and id, takes the unused row of right (o_id, ox, oy, oi) of least cost |dx| + 2 |dy| + 2 |di|."""
    n, named = len(keys), [f"__{k}" for k in keys]

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"id": [], "o_id": [], "cost": []})
        free: dict = {}
        for r in b[[*named, "oi", "o_id", "ox", "oy"]].sort_values(["oi", "o_id"]).itertuples(index=False, name=None):
            free.setdefault(r[:n], []).append(r[n:])
        out = []
        for r in a[[*keys, "i", "id", "x0", "y0"]].sort_values(["i", "id"]).itertuples(index=False, name=None):
            near = free.get(r[:n])
            if near:
                i, key, x, y = r[n:]
                cost, k = min((abs(x - o[2]) + 2 * abs(y - o[3]) + 2 * abs(i - o[0]), k) for k, o in enumerate(near))
                out.append((key, near.pop(k)[1], float(cost)))
        return pd.DataFrame(out, columns=["id", "o_id", "cost"])

    schema = T.StructType([left.schema["id"], right.schema["o_id"], T.StructField("cost", T.DoubleType())])
    bucket = _bucket(left, keys).alias("__bucket")
    a = left.select(*keys, "i", "id", "x0", "y0", bucket)
    # the sides may come from one table, so the right one's columns get names of their own
    b = right.select(*[F.col(k).alias(c) for k, c in zip(keys, named, strict=True)], "oi", "o_id", "ox", "oy", bucket.alias("__place"))
    return a.groupBy("__bucket").cogroup(b.groupBy("__place")).applyInPandas(match, schema)


def largest_matching(edges: list[tuple]) -> dict:
    """Left to right of a largest matching: each left, in sorted order, takes the nearest free right that alternating edges lead to."""
    near: dict = {}
    for a, b in sorted(set(edges)):
        near.setdefault(a, []).append(b)
    of_left: dict = {}
    of_right: dict = {}
    for a in near:
        came, queue, end = {}, deque([a]), None
        while queue and end is None:
            x = queue.popleft()
            for b in near[x]:
                if b not in came:
                    came[b] = x
                    if b not in of_right:
                        end = b
                        break
                    queue.append(of_right[b])
        while end is not None:
            x = came[end]
            of_right[end], of_left[x], end = x, end, of_left.get(x)
    return of_left


def maximum_matching(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """A largest one-to-one subset of pairs (left, right) of each key."""

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        groups: dict = {}
        for r in pdf[[*keys, "left", "right"]].itertuples(index=False, name=None):
            groups.setdefault(r[:-2], []).append(r[-2:])
        found = [pair for edges in groups.values() for pair in sorted(largest_matching(edges).items())]
        return pd.DataFrame(found, columns=["left", "right"])

    pairs = cut(pairs)
    bucket = _bucket(pairs, keys).alias("__bucket")
    return pairs.select("*", bucket).groupBy("__bucket").applyInPandas(match, T.StructType([pairs.schema["left"], pairs.schema["right"]]))


def largest_flow(demand: dict, supply: dict, near: dict) -> int:
    """Most units of demand that supply can meet where each demand reaches its near supplies alone: shortest augmenting paths, each by its narrowest place."""
    left, open_ = dict(supply), dict(demand)
    given: dict = {}
    takers: dict = {}
    met = 0
    for d in demand:
        while open_[d] > 0:
            came, queue, end = {("d", d): None}, deque([d]), None
            while queue and end is None:
                x = queue.popleft()
                for s in near.get(x, ()):
                    if ("s", s) in came:
                        continue
                    came["s", s] = x
                    if left.get(s, 0) > 0:
                        end = s
                        break
                    for o in takers.get(s, ()):
                        if given[s, o] > 0 and ("d", o) not in came:
                            came["d", o] = s
                            queue.append(o)
            if end is None:
                break
            path, s = [], end
            while s is not None:
                x = came["s", s]
                path.append((x, s))
                s = came["d", x]
            # what each demand on the way gives up is what the one before it takes
            units = min([open_[d], left[end], *(given[came["d", x], x] for x, _ in path if came["d", x] is not None)])
            for x, s in path:
                given[s, x] = given.get((s, x), 0) + units
                takers.setdefault(s, {})[x] = None
                if came["d", x] is not None:
                    given[came["d", x], x] -= units
            left[end] -= units
            open_[d] -= units
            met += units
    return met


def shortfalls(demand: DataFrame, supply: DataFrame, near: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: units needed, matched and missing, for demand (d, need), supply (s, have) and reach near (d, s)."""
    d = demand.groupBy(*keys).agg(F.collect_list(F.struct("d", "need")).alias("ds"))
    s = supply.groupBy(*keys).agg(F.collect_list(F.struct("s", "have")).alias("ss"))
    n = near.groupBy(*keys).agg(F.collect_list(F.struct("d", "s")).alias("ns"))

    def flow(batches):
        for pdf in batches:
            rows = []
            for ds, ss, ns in zip(pdf["ds"], pdf["ss"], pdf["ns"], strict=True):
                need = {x["d"]: int(x["need"]) for x in ds}
                reach: dict = {}
                for x in [] if ns is None else ns:
                    reach.setdefault(x["d"], []).append(x["s"])
                met = largest_flow(dict(sorted(need.items())), {} if ss is None else {x["s"]: int(x["have"]) for x in ss}, {k: sorted(v) for k, v in reach.items()})
                rows.append((sum(need.values()), met, sum(need.values()) - met))
            yield pd.concat([pdf[keys].reset_index(drop=True), pd.DataFrame(rows, columns=["required", "matched", "missing"])], axis=1)

    schema = T.StructType([demand.schema[k] for k in keys] + [T.StructField(x, T.LongType()) for x in ("required", "matched", "missing")])
    return d.join(s, keys, "left").join(n, keys, "left").mapInPandas(flow, schema)
