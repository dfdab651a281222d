"""Named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.sqlviews import compose
from tidemark.plans.views import Views

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    def register(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = compose(sql, extra)
        return fn

    return register


def rounded(df: DataFrame, *cols: str, digits: int = 8) -> DataFrame:
    """Sums of doubles depend on their order in the last bits; compare them at eight decimals."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


def bind(fn: Callable[[Views], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(Views(spark, sf_dir))
