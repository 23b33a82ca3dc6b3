"""Registry of named queries: ``name -> (spark callable, optional DuckDB oracle SQL)``.

Each registered query takes ``(spark, sf_dir)``, reads the driver tables (or the encounter
extract Spark derives from them) in full, and returns a lazy DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every catalog module so its queries register themselves."""
    from pertinax.plans import (catalog_clinical, catalog_metrics, catalog_ml,  # noqa: F401
                                catalog_profile, catalog_tables)
