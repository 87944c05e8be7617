"""Providers and processors that are plugged in: what they return is held against declared rules, and what they raise stays with the record that raised it.

Answers pass through Python once, as JSON; all rules about them are columns, so that a rule is one line and its order is the order of the list.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields of a source that a suggestion may change, and states that a processor may answer.
GOVERNED = ("source_title", "issuer", "official_url", "document_type", "source_status", "inclusion_rationale")
STATES = ("empty", "partial", "failed", "unavailable", "candidate")
#: What an answer must repeat of its request.
IDENTITY = ("request_id", "material_id", "source_id", "scope", "input_revision", "input_hash")


def first_broken(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that does not hold; a rule that is null does not. Null where all hold."""
    return F.coalesce(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules])


def answers(records: DataFrame, providers: dict[str, Callable[[dict], list]]) -> DataFrame:
    """(provider, asked, answer, raised): one row for each element of what a provider returns about a record, as JSON; an answer that is no list is one row with itself
    as raised. A provider is asked about one record at a time and sees a copy of it, so what it raises costs no other record."""
    columns = records.columns

    def ask(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False, name=None):
                record = dict(zip(columns, row, strict=True))
                for name, provider in providers.items():
                    try:
                        got = provider(dict(record))
                        texts = [json.dumps(x, sort_keys=True, default=str) for x in got] if isinstance(got, list) else None
                        rows += [(name, record["source_id"], x, None) for x in texts] if texts is not None else [(name, record["source_id"], None, "ValueError: not a list")]
                    except Exception as e:  # noqa: BLE001
                        rows.append((name, record["source_id"], None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["provider", "asked", "answer", "raised"])

    return records.mapInPandas(ask, "provider string, asked string, answer string, raised string")


def suggestions(records: DataFrame, providers: dict[str, Callable[[dict], list]]) -> DataFrame:
    """(provider, source_id, review_id, reason, updates, error) of each answer of each provider: a suggestion is an object about the record that was asked of, with a reason, and
    changes governed fields alone; whatever is not has an error in its place. The review id depends on what is suggested alone."""
    field = lambda name: F.get_json_object("answer", f"$.{name}")
    reason, updates = F.trim(field("reason")), F.coalesce(field("proposed_updates"), F.lit("{}"))
    keys = F.json_object_keys(updates)
    broken = first_broken(
        ("not an object", F.json_object_keys("answer").isNotNull()),
        ("unknown source_id", F.trim(field("source_id")) == F.col("asked")),
        ("non-governed fields", F.size(F.array_except(keys, F.array(*map(F.lit, GOVERNED)))) == 0),
        ("no reason", F.length(reason) > 0),
    )
    told = answers(records, providers).withColumn("error", F.coalesce("raised", F.concat(F.lit("ValueError: "), broken)))
    good = lambda c: F.when(F.col("error").isNull(), c)
    review = F.sha2(F.to_json(F.struct("provider", "asked", reason.alias("reason"), updates.alias("updates"))), 256)
    return told.select("provider", F.col("asked").alias("source_id"), good(review).alias("review_id"), good(reason).alias("reason"), good(updates).alias("updates"), "error")


def status(found: DataFrame) -> DataFrame:
    """(provider, status, items, errors): DEGRADED where a provider has failed on some record."""
    errors = F.count("error")
    return found.groupBy("provider").agg(F.when(errors > 0, "DEGRADED").otherwise("PASS").alias("status"), F.count("review_id").alias("items"), errors.alias("errors"))


def verdict(request: dict[str, Column], answer: dict[str, Column]) -> Column:
    """What is wrong with an answer: it is not bound to its request, its source and its scope, has an unknown state, or confirms what only a person may; null where nothing is."""
    bound = [request[k] == answer[k] for k in IDENTITY]
    return first_broken(
        ("identity_mismatch", F.forall(F.array(*[F.coalesce(b, F.lit(False)) for b in bound]), lambda b: b)),
        ("invalid_state", answer["state"].isin(*STATES)),
        ("cannot_confirm", answer["human_adoption_required"] & ~F.coalesce(answer["human_confirmed"], F.lit(False))),
    )
