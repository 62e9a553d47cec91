"""Name -> (Spark query, oracle SQL) of everything that can be run on the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans.fixtures import Tables
from ledgerloom.plans.oracles import oracle_query
from ledgerloom.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables``; ``sql`` is its oracle (none: rows are only counted).

    A query sets the run-time settings its plans rely on, as the session may be any.
    """

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Tables(tune(spark), sf_dir))
        if sql is not None:
            ORACLES[name] = oracle_query(sql)
        return build

    return register
