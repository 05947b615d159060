"""What operators need of a session: the folder that all executors share, tables in it, and this package on the executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only on one machine (a local master) a temporary folder may stand for it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="loomline-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the application's own folder within the shared one."""
    return f"{shared_dir(spark)}/loomline-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Remove what this application has written to scratch. Results that are still to be computed may read it: call this when they are written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/loomline-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, tag: str, rows: int | None = None, rows_a_file: int = 250_000) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, outlives executors and gives Catalyst real sizes.

    Where a bound of its rows is known, small tables go to few files: at least 8, and one per ``rows_a_file``.
    """
    path = scratch_path(df.sparkSession, tag)
    (df if rows is None else df.coalesce(max(8, rows // rows_a_file))).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python can import it: Spark serves the archive from the driver."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    out = os.path.join(tempfile.mkdtemp(prefix="loomline-code-"), f"{root.name}.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(out)
    _SHIPPED.add(app)
