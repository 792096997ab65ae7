"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODULES = ("vector_queries", "search_queries", "retrieval_queries", "fusion_queries", "analytics_queries", "event_queries", "catalog_queries")
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
WIDER = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double"}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows. Whole numbers come as longs."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[F.col(f"`{c}`").cast(WIDER[t]).alias(c) if t in WIDER else F.col(f"`{c}`") for c, t in df.dtypes])

        _QUERIES[f.__name__] = run
        if sql is not None:
            _SQL[f.__name__] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    for m in MODULES:
        import_module(f"vectorloom.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
