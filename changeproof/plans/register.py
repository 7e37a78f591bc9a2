"""A module's queries by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Register:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def add(fn):
            if fn.__name__ in self.queries:
                raise ValueError(f"query {fn.__name__} is registered twice")
            self.queries[fn.__name__] = fn
            if sql is not None:
                self.oracle[fn.__name__] = sql
            return fn

        return add
