"""Orders that are kept by keys: a moved unit gets a key between its neighbours' and no other unit is touched.

A key is a way down the Stern-Brocot tree of all fractions, L for left and R for right, closed by M. L < M < R, so keys compare as plain text in the order of their
fractions. Between any two keys there is always another, one step longer at most than the longer of them, where doubles end after some fifty moves to one place.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

END = "M"


def between(low: str | None, high: str | None) -> str:
    """A key between two; None stands for the ends of the order."""
    a, b = (low or "").removesuffix(END), (high or "").removesuffix(END)
    if low is None and high is None:
        return END
    if low is None:
        return b + "L" + END
    if high is None:
        return a + "R" + END
    # of neighbours, one is an ancestor of the other or both are of a third
    if b.startswith(a):
        return b + "L" + END
    if a.startswith(b):
        return a + "R" + END
    n = next(i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y)
    return a[:n] + END


def fraction(key: str) -> tuple[int, int]:
    """The fraction that a key stands for, in whole numbers of any size."""
    a, b, c, d = 0, 1, 1, 0
    for step in key.removesuffix(END):
        if step == "L":
            c, d = a + c, b + d
        else:
            a, b = a + c, b + d
    return a + c, b + d


def first_keys(place: Column, count: Column) -> Column:
    """Keys for places 1 to count in order, as in a balanced tree: no longer than the logarithm of count."""
    depth = F.length(F.bin(count))
    bits = F.lpad(F.bin(place), depth, "0")
    return F.concat(F.translate(F.regexp_replace(bits, "10*$", ""), "01", "LR"), F.lit(END))


_MOVED = T.StructType([T.StructField("unit", T.LongType()), T.StructField("key", T.StringType()), T.StructField("moves", T.LongType()), T.StructField("refused", T.LongType())])


def moved(units: DataFrame, moves: DataFrame, document: str = "document") -> DataFrame:
    """(document, unit, key, moves, refused): the keys of units (document, unit, key) after moves (document, seq, unit, after) in their sequence, each putting a unit right
    after another one of its document, or first where after is null.

    A move is refused, and counted with its unit, where either unit is not in the document or a unit is put after itself. Keys depend on the moves before, so a document is replayed as a whole;
    documents are dealt out, sorted, and read as they come.
    """
    rows = units.select(document, F.lit(0).cast("long").alias("seq"), F.col("unit").cast("long").alias("unit"), "key", F.lit(None).cast("long").alias("after")).unionByName(
        moves.select(document, F.col("seq").cast("long").alias("seq"), F.col("unit").cast("long").alias("unit"), F.lit(None).cast("string").alias("key"), F.col("after").cast("long").alias("after"))
    )
    dealt = rows.repartition(document).sortWithinPartitions(document, "seq", F.col("key").isNull(), "unit")
    schema = T.StructType([units.schema[document], *_MOVED.fields])

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, None
        for pdf in batches:
            out = []
            for doc, unit, key, after in zip(pdf[document], pdf["unit"], pdf["key"], pdf["after"], strict=True):
                if held is None or doc != now:
                    out += _told(now, held)
                    now, held = doc, ({}, [], {})
                _step(held, int(unit), key, None if pd.isna(after) else int(after))
            yield pd.DataFrame(out, columns=schema.names)
        yield pd.DataFrame(_told(now, held), columns=schema.names)

    return dealt.mapInPandas(replay, schema)


def _step(held: tuple[dict, list, dict], unit: int, key: str | None, after: int | None) -> None:
    """One row of a document's replay: a unit with its key, or a move."""
    keys, order, counts = held
    if isinstance(key, str):
        keys[unit] = key
        counts[unit] = [0, 0]
        insort(order, key)
        return
    if unit not in keys or after == unit or (after is not None and after not in keys):
        counts.setdefault(unit, [0, 0])[1] += 1
        return
    order.pop(bisect_right(order, keys[unit]) - 1)
    at = 0 if after is None else bisect_right(order, keys[after])
    keys[unit] = between(order[at - 1] if at else None, order[at] if at < len(order) else None)
    order.insert(at, keys[unit])
    counts[unit][0] += 1


def _told(document, held) -> list[tuple]:
    return [] if held is None else [(document, unit, held[0].get(unit), *n) for unit, n in held[2].items()]
