"""The table of embedded chunks: file_path, content, vector."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import deleted, is_vector, upserted

SCHEMA = "file_path string, content string, vector array<float>"
MOST = 3000  # characters of a file that are embedded


def open_table(spark: SparkSession, path: str) -> DataFrame:
    """The table, or an empty one with its schema."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], SCHEMA)


def embedded(files: DataFrame, embed) -> DataFrame:
    """Chunks of (path, content): texts are cut before they reach the model."""
    cut = files.select(F.col("path").alias("file_path"), F.substring("content", 1, MOST).alias("content"))
    return cut.withColumn("vector", embed("content"))


def with_files(table: DataFrame, chunks: DataFrame) -> DataFrame:
    """The table after an upsert; a file whose embedding failed keeps its old row."""
    return upserted(table, chunks, "file_path", is_vector("vector"))


def stale(table: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files whose row is old because their embedding failed."""
    return chunks.filter(~is_vector("vector")).select("file_path").join(table.select("file_path"), "file_path", "left_semi")


def without_files(table: DataFrame, gone: DataFrame) -> DataFrame:
    return deleted(table, gone.select(F.col("path").alias("file_path")), "file_path")
