"""Queries op11 and op13 over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import importance, winnow
from .common import table


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op11_importance_resampling": op11_importance_resampling, "op13_winnowing": op13_winnowing}
ORACLES = {"op13_winnowing": winnow.ORACLE_SQL}
