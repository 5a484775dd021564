"""Registered queries: a Spark plan and, where SQL can say the same, a check in plain SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tallyhouse.catalogue.check_tables import with_tables
from tallyhouse.functions.money import present
from tallyhouse.plans.firm import Firm


@dataclass(frozen=True)
class Query:
    name: str
    plan: Callable[[Firm], DataFrame]
    check: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return present(self.plan(Firm.sample(spark, folder)))


REGISTERED: dict[str, Query] = {}


def query(name: str, check: str | None = None):
    """Register a plan under its inventory id; ``check`` may use the ``r_*`` tables."""

    def keep(plan: Callable[[Firm], DataFrame]) -> Callable[[Firm], DataFrame]:
        if name in REGISTERED:
            raise ValueError(f"duplicate query {name}")
        REGISTERED[name] = Query(name, plan, with_tables(check) if check else None)
        return plan

    return keep
