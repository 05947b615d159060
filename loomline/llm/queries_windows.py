"""Query op12 over the whole table of clicks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import rolling
from .common import table


def op12_rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.rolling_medians(table(spark, sf_dir, "clicks"), 60)


QUERIES = {"op12_rolling_median": op12_rolling_median}
ORACLES = {"op12_rolling_median": rolling.ORACLE_SQL}
