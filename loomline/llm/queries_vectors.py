"""Query op4 over the whole table of embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann
from .common import table


def op4_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {"op4_posting_lists": op4_posting_lists}
ORACLES: dict[str, str] = {}
