"""All queries of the factor engine: importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crosspanel.plans import queries_analysis, queries_panel, queries_study  # noqa: F401  they register themselves
from crosspanel.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The information coefficient by month and horizon."""
    return QUERIES["ic"](spark, sf_dir)
