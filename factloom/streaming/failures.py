"""Failures of documents' processing as a stream: stopped attempts are kept, and codes that a later attempt recovers from are retired.

Events are (item, seq, kind, code): kind is failed, with the code of what stopped an attempt, or usable, for a result that can be used. A failure that is the same as the one kept last is not kept again.
Codes of others' making (upstream_, canonical_) are not retired by a usable result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Codes that only their owners retire.
KEPT = ("upstream_", "canonical_")
EVENT = "item long, seq long, kind string, code string"
OUT = T.StructType([T.StructField("item", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("event", T.StringType()), T.StructField("code", T.StringType())])


def step(open_codes: list[str], kind: str, code: str | None) -> tuple[list[str], list[tuple[str, str]]]:
    """(codes open after an event, (event, code) that it makes): retained for a failure that is not open yet, recovered for each code that a usable result retires."""
    if kind == "failed" and code is not None and code not in open_codes:
        return [*open_codes, code], [("retained", code)]
    if kind == "usable":
        gone = [c for c in open_codes if not c.startswith(KEPT)]
        return [c for c in open_codes if c.startswith(KEPT)], [("recovered", c) for c in gone]
    return open_codes, []


_HELD = T.StructType([T.StructField("codes", T.ArrayType(T.StringType()))])


def _held(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    open_codes = list(state.get[0]) if state.exists else []
    events, out = pd.concat(list(batches)).sort_values("seq"), []
    for seq, kind, code in zip(events["seq"], events["kind"], events["code"], strict=True):
        open_codes, made = step(open_codes, kind, None if pd.isna(code) else code)
        out += [(key[0], seq, event, c) for event, c in made]
    if open_codes:
        state.update((open_codes,))
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=OUT.names)


def retained(events: DataFrame) -> DataFrame:
    """Streaming events to what is kept and what is retired. An item has state only while codes of it are open, so the store holds what is broken, not all that ever was."""
    return events.groupBy("item").applyInPandasWithState(_held, OUT, _HELD, "append", GroupStateTimeout.NoTimeout)


def folded(events: DataFrame) -> DataFrame:
    """The same of a whole log at once: items are dealt out and read in order."""

    def fold(batches):
        now, open_codes = None, []
        for pdf in batches:
            out = []
            for item, seq, kind, code in zip(pdf["item"], pdf["seq"], pdf["kind"], pdf["code"], strict=True):
                if item != now:
                    now, open_codes = item, []
                open_codes, made = step(open_codes, kind, None if pd.isna(code) else code)
                out += [(item, seq, event, c) for event, c in made]
            yield pd.DataFrame(out, columns=OUT.names)

    return events.select(F.col("item").cast("long"), F.col("seq").cast("long"), "kind", "code").repartition("item").sortWithinPartitions("item", "seq").mapInPandas(fold, OUT)
