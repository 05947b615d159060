"""Queries op7 and op9 over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import langid, toxicity
from .common import table


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op7_language_id": op7_language_id, "op9_toxicity": op9_toxicity}
ORACLES: dict[str, str] = {}
