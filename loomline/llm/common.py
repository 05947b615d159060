"""Helpers shared by the operators: table reading, shared scratch tables, code shipping."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch
from ..sources.scratch import scratch_path, written

__all__ = ["BATCH_ROWS", "WORD", "held_out", "partitions", "scratch_path", "ship", "table", "tidy", "written"]

#: One word of a text, in Java and Python syntax alike.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch at most. Texts can be long: smaller batches bound what a task holds on both sides.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Ready the session for operators in Python: bounded Arrow batches, and this package on the executors."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    scratch.ship(spark)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` with memory handed back to the system after each task: workers are kept for later tasks, of other operators too."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return tidied


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(id_col: str = "doc_id"):
    """True for rows kept out of training: crc32 of the id as text is divisible by 5 (a null id is kept out of training too)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))
