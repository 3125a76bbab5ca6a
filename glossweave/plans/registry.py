"""Registered queries: a Spark plan, the operator ids it covers and (where SQL can say it) the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    ids: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(ids: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        CATALOG[fn.__name__] = Query(fn.__name__, ids, fn, sql)
        return fn

    return register
