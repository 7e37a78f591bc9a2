"""The registered queries of the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from changeproof.plans import coverage_queries, delta_queries, evidence_queries, live_queries, log_queries, privacy_queries, record_queries, suite_queries, web_queries
from changeproof.plans.register import Register

MODULES: list[Register] = [m.REGISTER for m in (delta_queries, log_queries, suite_queries, coverage_queries, privacy_queries, web_queries, live_queries, record_queries, evidence_queries)]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in MODULES for name, query in m.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.oracle.items()}
