"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeline.plans import general, loading, pipelines, retrieval

MODULES = [retrieval, pipelines, loading, general]


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.graph_conditioned_search(spark, sf)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.oracle_sql().items()}
