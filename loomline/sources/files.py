"""Source trees: listing without contents, contents on demand, sizes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .logs import opened
from .scratch import ship

#: Folders that are never scanned, by exact name (fixed values).
SKIPPED = ("node_modules", "dist", ".git")
SUFFIXES = "*.{ts,tsx}"


def _binary(spark: SparkSession, root: str, glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    plain = re.sub(r"([\[\]{}*?\\])", r"\\\1", root)  # a folder's name is no pattern
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(plain)


def _relative(root: str):
    """The path below the root: what follows its last folder's place, taken as plain text."""
    plain = F.regexp_replace("path", "^file:/+", "/")
    own = F.lit(re.sub("^file:/+", "/", root.rstrip("/")) + "/")
    return F.when(F.startswith(plain, own), F.substr(plain, F.length(own) + 1)).otherwise(plain)


def _wanted(df: DataFrame, skipped: tuple[str, ...]) -> DataFrame:
    parts = F.split("relative_path", "/")
    return df.filter(~F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(s) for s in skipped])))


def scan(spark: SparkSession, root: str, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """Snapshot (path, relative_path, mtime, size) of the sources below a folder: listed only, contents aren't read."""
    rows = _binary(spark, root, SUFFIXES).select("path", _relative(root).alias("relative_path"), (F.unix_micros("modificationTime") / 1000).alias("mtime"), F.col("length").alias("size"))
    return _wanted(rows, skipped)


def read_sources(spark: SparkSession, root: str, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(path, content) of the sources below a folder, by relative path."""
    rows = _binary(spark, root, SUFFIXES).select("path", _relative(root).alias("relative_path"), F.decode("content", "UTF-8").alias("content"))
    return _wanted(rows, skipped).select(F.col("relative_path").alias("path"), "content")


def tree_bytes(spark: SparkSession, root: str) -> DataFrame:
    """One row: bytes of all files below a folder. Folders' own entries, which file systems size in their own way, don't count."""
    return _binary(spark, root, None).agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes"))


def index_bytes(spark: SparkSession, *roots: str) -> int:
    """Bytes of all files below the folders (manifest and vectors, say) together; one that isn't there counts as empty."""
    from pyspark.errors import AnalysisException

    total = 0
    for root in roots:
        try:
            total += tree_bytes(spark, root).first()["bytes"]
        except AnalysisException:
            continue
    return total


def contents(paths: DataFrame, root: str = "") -> DataFrame:
    """(path, content, error) of the files named by ``paths`` (path), absolute or below the root: one that can't be read has its error and the others go on.

    Files that aren't there are left out. Bytes that aren't UTF-8 become a replacement mark. Paths are spread over tasks as they come.
    """
    ship(paths.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path in part["path"].dropna():  # a file at a time
                try:
                    with opened(path if path.startswith("/") or not root else f"{root.rstrip('/')}/{path}") as f:
                        yield pd.DataFrame([(path, f.read().decode("utf-8", "replace"), None)], columns=["path", "content", "error"])
                except FileNotFoundError:
                    continue
                except OSError as e:
                    yield pd.DataFrame([(path, None, str(e))], columns=["path", "content", "error"])

    return paths.select("path").distinct().mapInPandas(run, "path string, content string, error string")


def append_json(rows: DataFrame, path: str) -> None:
    """A log of JSON lines."""
    rows.write.mode("append").json(path)
