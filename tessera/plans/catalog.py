"""The registered queries of the engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import checks, documents, indexing, retrieval, services, stored, tables

_MODULES: list = [checks, documents, indexing, retrieval, services, stored, tables]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All registered queries by name."""
    return {k: q for m in _MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """All registered SQL twins by name."""
    return {k: s for m in _MODULES for k, s in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval over the documents table."""
    return retrieval.hybrid_recall(spark, sf_dir)
