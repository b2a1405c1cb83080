"""The queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from souqframe.plans import cleaning_queries, data_queries, feature_queries, lookup_queries, market_queries, model_queries, more_queries, rule_queries, source_queries, split_queries
from souqframe.session import ship_package

_MODULES = (data_queries, cleaning_queries, market_queries, lookup_queries, split_queries, rule_queries, source_queries, model_queries, more_queries, feature_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: s for m in _MODULES for k, s in m.ORACLE.items()}


def with_package(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, run where every worker has the package."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run
