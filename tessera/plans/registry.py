"""How queries are registered: a pipeline or a function over the given tables, with the same question in SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.database import Database

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def pipeline(name: str, collection: str, stages: list[dict], sql: str | None = None, finish: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    QUERIES[name] = lambda spark, sf_dir: finish(Database(spark, sf_dir)[collection].aggregate(stages))
    if sql:
        SQL[name] = sql


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Database(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def flat(**columns: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.select(*[F.expr(e).alias(n) for n, e in columns.items()])


R2 = lambda e, n=2: {"$round": [e, n]}


def matching(name: str, table: str, key: str, spec: dict, sql: str, before: list[dict] | None = None, source: str | None = None) -> None:
    pipeline(name, table, [*(before or []), {"$match": spec}, {"$project": {"_id": 0, key: 1}}], f"SELECT {key} FROM {source or table} WHERE {sql}")


def expression(name: str, table: str, key: str, fields: dict, sql: str, extra: dict | None = None) -> None:
    pipeline(name, table, [*([{"$set": extra}] if extra else []), {"$project": {"_id": 0, key: 1, **fields}}], f"SELECT {key}, {sql} FROM {table}")
