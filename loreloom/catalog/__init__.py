"""Registered queries: each binds library operators to the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Registry:
    """Name to query, with the matching SQL where SQL can say the same."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def register(function: Query) -> Query:
            self.queries[function.__name__] = function
            if sql is not None:
                self.sql[function.__name__] = sql
            return function

        return register


registry = Registry()


def load_all() -> Registry:
    from loreloom.catalog import (  # noqa: F401
        accounting, answers, corpus, dedup, events, memory, records, retrieval, streams, text,
    )

    return registry
