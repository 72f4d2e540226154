"""All registered queries of the library and their SQL for checking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import checks, matching, registry, robustness, tables  # noqa: F401  registering them


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.flagship(spark, sf_dir)
