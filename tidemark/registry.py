"""Registered queries of the bias engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import registered, registered_edges, registered_fits, registered_more, registered_names  # noqa: F401 - registers its queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registered.flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registered.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registered.ORACLES)
