"""Registered queries: a name, a Spark plan and, where SQL can say the same, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crowdgauge.plans.oracle_views import with_views
from crowdgauge.sources.binding import Binding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, needs: str = "", sql: str | None = None):
    """Register ``plan(binding) -> DataFrame`` under a name."""

    def register(plan: Callable[[Binding], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, directory: str) -> DataFrame:
            return plan(Binding(spark, directory))

        run.__doc__ = plan.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(needs, sql)
        return plan

    return register
