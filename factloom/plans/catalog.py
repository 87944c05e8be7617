"""The register of queries: each has a name, a plan, and, where SQL can say the same, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.sources.derived import Tables

PLANS: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None, whole: tuple[str, ...] = ()):
    """Registers a plan over Tables under a name that begins with its number in the operator inventory.

    whole names columns that DuckDB sums to 128 bits and Spark to 64.
    """
    if whole:
        casts = ", ".join(f"cast({c} as bigint) as {c}" for c in whole)
        oracle = f"select * replace ({casts}) from ({oracle})"

    def register(plan: Callable[[Tables], DataFrame]):
        if name in PLANS:
            raise ValueError(f"{name} twice")
        PLANS[name] = plan
        if oracle:
            ORACLE[name] = oracle
        return plan

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from factloom.plans import load

    load()
    return {name: (lambda spark, sf_dir, plan=plan: plan(Tables(spark, sf_dir))) for name, plan in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    from factloom.plans import load

    load()
    return dict(ORACLE)
