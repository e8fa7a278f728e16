"""Every query of the core: name -> (query, SQL that must give the same rows).

The queries live in the `plans` modules by subject; each module registers its own on import.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skriva.plans import catalog_data, catalog_review, catalog_search, catalog_sessions, catalog_text
from skriva.plans.registry import QUERIES, SQL, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["rrf_fusion"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


__all__ = ["catalog_data", "catalog_review", "catalog_search", "catalog_sessions", "catalog_text", "flagship", "oracle_sql", "queries"]
