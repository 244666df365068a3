"""Registry of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
MODULES = (
    "sources", "bucketing", "text", "observations", "actions", "answers", "audits",
    "scoring", "reports", "chats", "episodes", "inventories", "pages", "streams",
)


class Tables:
    """Lazy access to the tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    name: str
    operator: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, operator: str, sql: str | None = None):
    """Register a query under ``name`` for the operator ids it covers."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, operator, build, sql)
        return build

    return register


def load() -> dict[str, Query]:
    for module in MODULES:
        import_module(f"trailmark.catalog.{module}")
    return REGISTRY


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(q: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: q.build(Tables(spark, folder))

    return {name: bind(q) for name, q in load().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in load().items() if q.sql is not None}
