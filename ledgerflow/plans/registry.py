"""Registered queries: each pairs a Spark plan over the bridge views with an
independent DuckDB statement over the same driver tables.

Money is computed exactly (DECIMAL / integer cents) inside every plan; only
the final output columns listed as ``money`` are handed out as DOUBLE, in both
engines, so the two results compare value for value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.bridge import Bridge, bridge
from .oracle_views import with_views


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    code: str


REGISTRY: dict[str, Query] = {}


def finalize(df: DataFrame) -> DataFrame:
    """Decimal outputs become DOUBLE (exact decimal → correctly rounded double)."""
    cols = [F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(*cols)


def _wrap_money(sql: str, money: Iterable[str]) -> str:
    money = list(money)
    if not money:
        return sql
    rep = ", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in money)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS q"


def query(name: str, code: str, oracle: str | None = None, views: Iterable[str] = (),
          money: Iterable[str] = ()):
    """Register ``fn(bridge) -> DataFrame`` under ``name`` with its DuckDB oracle."""

    def deco(fn: Callable[[Bridge], DataFrame]):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finalize(fn(bridge(spark, sf_dir)))

        sql = None if oracle is None else _wrap_money(with_views(tuple(views), oracle), money)
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, build, sql, code)
        return fn

    return deco


def load_all() -> dict[str, Query]:
    # importing the plan modules fills the registry
    from . import (audit_queries, bank_queries, event_queries, inventory_queries, ops_queries, ledger_queries, posting_queries,  # noqa: F401
                   quality_queries, secure_tier_queries, staging_queries, tax_payroll_queries)
    return REGISTRY
