"""Queries op1 and op10 over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import mixing, sharding
from .common import table


def op1_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.ring_shards(table(spark, sf_dir, "documents"), 8)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op1_ring_shards": op1_ring_shards, "op10_mix_sources": op10_mix_sources}
ORACLES = {"op10_mix_sources": mixing.ORACLE_SQL}
