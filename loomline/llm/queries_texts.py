"""Queries op3 and op6 over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, secret_scan
from .common import table


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.span_digests(secret_scan.scan_secrets(table(spark, sf_dir, "documents")))


def op6_piecewise_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_neighbours(table(spark, sf_dir, "documents"))


QUERIES = {"op3_secret_scan": op3_secret_scan, "op6_piecewise_fingerprints": op6_piecewise_fingerprints}
ORACLES: dict[str, str] = {}
